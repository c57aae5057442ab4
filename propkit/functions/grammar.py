"""Structure-string profile (E1–E4) as one Column job over a string column.

The reference parses each string with a chemistry toolkit in a process pool.  Here
the same questions are answered by a token grammar evaluated inside the JVM:
atom tokens by ``regexp_extract_all``, counts by higher-order array functions.

Documented deviations (see README): aromaticity is "a lower-case atom is present"
(no Kekulé perception); molecular weight sums heavy atoms plus hydrogens written
inside brackets (implicit hydrogens are not derived); an explicit ``[H]`` token is
not counted as an atom when another atom is present.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token grammar.
ATOM_RE = r"(\[[^\]]+\]|Br|Cl|[BCNOPSFI]|[bcnops])"
SYMBOL_RE = r"^\[?[0-9]*([A-Z][a-z]?|[a-z]{1,2})"
BRACKET_H_RE = r"^\[[0-9]*(?:[A-Z][a-z]?|[a-z]{1,2})@*(H[0-9]*)?"
VALID_RE = (r"^(\[[0-9]*(?:[A-Z][a-z]?|[a-z]{1,2})[^\[\]]*\]|Br|Cl|[BCNOPSFI]|[bcnops]"
            r"|[-=#$:/\\.()]|%[0-9]{2}|[0-9])+$")
BRACKET_RE = r"\[[^\]]*\]"
RING_RE = r"(%[0-9]{2}|[0-9])"
AROMATIC_RE = r"^\[?[0-9]*[a-z]"

# Element symbols in order of atomic number (Z = position, 1-based).
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn "
    "Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce "
    "Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn "
    "Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl "
    "Mc Lv Ts Og"
).split()
assert len(SYMBOLS) == 118

# Monoisotopic masses (most abundant isotope) of the elements the
# mass column supports; any other element gives a NULL weight.
MASSES = {
    "H": 1.00782503223, "Li": 7.0160034366, "B": 11.00930536, "C": 12.0,
    "N": 14.00307400443, "O": 15.99491461957, "F": 18.99840316273, "Na": 22.989769282,
    "Mg": 23.985041697, "Al": 26.98153853, "Si": 27.97692653465, "P": 30.97376199842,
    "S": 31.9720711744, "Cl": 34.968852682, "K": 38.9637064864, "Ca": 39.962590863,
    "Fe": 55.93493633, "Cu": 62.92959772, "Zn": 63.92914201, "Se": 79.9165218,
    "Br": 78.9183376, "I": 126.9044719,
}
H_MASS = MASSES["H"]

# Element category by atomic number, as the first-match rule resolves:
# Z 3-10 and 19-85 "Metal"; 11 and 87 "Alkali Metal"; 1, 2 and 14-17 "Non-metal";
# everything else "Other" (its Lanthanide branch is unreachable).
CATEGORY_RULES = [
    ("Metal", [(3, 10), (19, 85)]),
    ("Alkali Metal", [(11, 11), (87, 87)]),
    ("Non-metal", [(1, 2), (14, 17)]),
]


def category_of_z(z: Column) -> Column:
    expr = None
    for name, ranges in CATEGORY_RULES:
        cond = None
        for lo, hi in ranges:
            c = (z >= lo) & (z <= hi)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("Other"))


def _cap(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 2)))


def counter_map(arr: Column) -> Column:
    """Counter of an array as MAP<STRING,INT> in first-seen key order."""
    return F.map_from_entries(F.transform(
        F.array_distinct(arr),
        lambda k: F.struct(k.alias("key"), F.size(F.filter(arr, lambda x: x == k)).alias("value"))))


def canonical_counter(arr: Column) -> Column:
    """Counter of an array as a sorted 'key:count,...' string (for comparisons)."""
    return F.array_join(F.array_sort(F.transform(
        F.array_distinct(arr),
        lambda k: F.concat(k, F.lit(":"), F.size(F.filter(arr, lambda x: x == k)).cast("string")))), ",")


def clean_structure(col: Column) -> Column:
    """P2 applied to a structure string: drop non-breaking spaces, trim."""
    return F.trim(F.regexp_replace(col.cast("string"), "\u00a0", ""))


def profile_stages(col: str):
    """Ordered (name, Column-builder) stages; each builder gets a resolver for names."""
    symbols = F.array(*[F.lit(x) for x in SYMBOLS])
    mass_map = F.create_map(*[v for k, m in MASSES.items() for v in (F.lit(k), F.lit(m))])
    return [
        ("_s", lambda c: clean_structure(c(col))),
        ("_all", lambda c: F.regexp_extract_all(c("_s"), F.lit(ATOM_RE), 1)),
        ("_labels", lambda c: F.regexp_extract_all(F.regexp_replace(c("_s"), BRACKET_RE, ""), F.lit(RING_RE), 1)),
        ("_toks", lambda c: F.when(F.exists(c("_all"), lambda t: t != "[H]"),
                                   F.filter(c("_all"), lambda t: t != "[H]")).otherwise(c("_all"))),
        ("_syms", lambda c: F.transform(c("_toks"), lambda t: _cap(F.regexp_extract(t, SYMBOL_RE, 1)))),
        ("_zs", lambda c: F.transform(c("_syms"), lambda x: F.array_position(symbols, x).cast("int"))),
        ("_aromatic", lambda c: F.exists(c("_toks"), lambda t: t.rlike(AROMATIC_RE))),
        ("is_valid", lambda c: (
            (F.length(c("_s")) > 0)
            & c("_s").rlike(VALID_RE)
            & (F.length(c("_s")) - F.length(F.replace(c("_s"), F.lit("("), F.lit("")))
               == F.length(c("_s")) - F.length(F.replace(c("_s"), F.lit(")"), F.lit(""))))
            & F.forall(c("_labels"), lambda lab: F.size(F.filter(c("_labels"), lambda z: z == lab)) % 2 == 0)
            & F.forall(c("_zs"), lambda z: z > 0)
            & (~c("_aromatic") | (F.size(c("_labels")) > 0)))),
        ("n_atoms", lambda c: F.size(c("_toks"))),
        ("is_aromatic", lambda c: c("_aromatic")),
        ("is_non_cyclic", lambda c: F.size(c("_labels")) == 0),
        ("is_cyclic_non_aromatic", lambda c: (F.size(c("_labels")) > 0) & ~c("_aromatic")),
        ("category", lambda c: F.when(F.array_contains(c("_syms"), "C"), F.lit("Organic")).otherwise(F.lit("Inorganic"))),
        ("molecular_weight", lambda c: F.aggregate(
            F.zip_with(c("_syms"), c("_toks"), lambda sym, t: F.try_element_at(mass_map, sym) + _bracket_h(t) * H_MASS),
            F.lit(0.0).cast("double"), lambda acc, m: acc + m)),
        ("elements", lambda c: counter_map(c("_syms"))),
        ("element_categories", lambda c: counter_map(F.transform(c("_zs"), category_of_z))),
    ]


def _bracket_h(tok: Column) -> Column:
    g = F.regexp_extract(tok, BRACKET_H_RE, 1)
    return (F.when(g == "", F.lit("0")).when(g == "H", F.lit("1"))
            .otherwise(F.substring(g, 2, 2**31 - 1)).cast("double"))


HELPERS = ("_s", "_all", "_labels", "_toks", "_syms", "_zs", "_aromatic")
