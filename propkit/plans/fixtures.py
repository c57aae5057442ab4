"""Structure strings for tables that carry no structure column.

The driver tables have no structure strings, so a structure column is derived from
``part``: row ``p_partkey`` takes entry ``p_partkey % len(STRUCTURES)``.  The work
therefore grows with ``part``; the list covers the edge cases of FIXTURES.md part C.
"""

# Structure strings (U+00A0 marks a non-breaking space).
STRUCTURES = [
    "C", "CCO", "C#N", "c1ccccc1", "C1CCCCC1", "CC(=O)Oc1ccccc1C(=O)O", "[NH4+]", "ClCBr", "O",
    "not_a_molecule(", "", "nan", "C\u00a0CO", "[nH]1cccc1", "[Na+].[Cl-]", "C%12CCCC%12", "[13CH4]",
    "CC(C)O", "c1ccncc1", "OCC(O)CO", "FC(F)(F)Cl", "CCS(=O)CC", "P(=O)(O)(O)O", "ClCCl", "CC(=O)N",
    "C1CC1", "[Si](C)(C)(C)C", "BrC(Br)Br", "CCCCCCCCCCCC", "c1ccc2ccccc2c1", "N#CC#N", "C1CC", "CC(C",
]
