"""Personal data by candidate boosting (operator 4), with DataFrame functions only.

Base spans are the strict matches of four kinds (email, ip, card, phone) and always count.
High-recall generators propose further, overlapping spans in looser formats; gradient
boosted trees over format and context features (trained in the JVM on at most
``SAMPLE_CANDIDATES`` candidates of each kind, by hash, labelled by what they hold: an address after undoing "at" and "dot", octets, a
Luhn number, or a phone number's digits with a plus or a cue before them)
score them, and a threshold per kind, calibrated on the candidates of all documents,
selects what is added.

The trees are turned into column expressions, so a text's spans come from one projection:
no shuffle, no row per candidate (the fit stores one).  Matches and their places come from splitting a text at
the matches: places are running sums of the pieces' lengths in code points.  The patterns
are the contract's, written so that Java's matcher neither recurses over long runs nor
starts anew inside a run that cannot match.

Null texts are empty; an empty text has no spans.  Repeated rows have equal results.  A
sample without good candidates adds nothing to the base spans.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propkit.llm._spark import hash_key, stored

KINDS = ("email", "ip", "card", "phone")
SAMPLE_CANDIDATES, PRECISION = 5000, 0.95  # candidates of a kind that the trees see
TREES, DEPTH, CONTEXT = 12, 3, 16

# a run of label characters, then ".x" again and again, without a loop over a group of varying length
_DOMAIN = r"[A-Za-z0-9-]++\.[A-Za-z0-9-](?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])*+"
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}  # a character without which there is no match
# generators: (kind proposed, pattern); they overlap each other and the base patterns
LOOSE = (
    ("email", rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9.])[0-9]{1,4}+\x20?\.\x20?[0-9]{1,4}+\x20?\.\x20?[0-9]{1,4}+\x20?\.\x20?[0-9]{1,4}+"),
    ("card", r"(?<![0-9])[0-9][0-9\x20.-]{11,28}(?<=[0-9])(?![0-9])"),
    ("phone", r"(?<![0-9])[+(]{0,2}+[0-9][\x20().0-9-]{7,22}(?<=[0-9])(?![0-9])"),
)
SPAN = "struct<kind:int,start:bigint,stop:bigint>"
FEATURES = ("kind", "length", "digits", "dots", "dashes", "blanks", "parens", "plus", "at", "letters", "groups", "luhn", "octets",
            "left_alnum", "right_alnum", "cue", "phone_cue")
_AT = r"\x20?(?:@|\(at\)|\[at\])\x20?"
_DOT = r"\x20?(?:\(dot\)|\[dot\])\x20?|\x20\.\x20"
_ADDRESS = r"^[A-Za-z0-9._%+-]*[A-Za-z0-9]@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)(?:[A-Za-z0-9-]+\.)*[A-Za-z][A-Za-z0-9-]*$"
_PHONE_CUE = r"(?i)(tel|phone|call|fax|mobil|contact)[^\n]*$"
_CUE = r"(?i)(mail|contact|tel|phone|call|fax|card|visa|pay|ip|host|server|addr)[^\n]*$"


def _quoted(pattern: str) -> str:
    """A pattern as a SQL string literal."""
    return "r'" + pattern.replace("'", "\\x27") + "'"


# SQL over one match or proposal ``t``
def _digits(t: str) -> str:
    return f"regexp_replace({t}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """Whether a digit string passes the Luhn check."""
    doubled = "if(i % 2 = 0, int(c), (int(c) * 2) div 10 + (int(c) * 2) % 10)"
    return f"aggregate(transform(filter(split(reverse({d}), ''), c -> c <> ''), (c, i) -> {doubled}), 0L, (a, v) -> a + v) % 10 = 0"


def _octets(t: str) -> str:
    """Whether all dotted parts are numbers up to 255."""
    short = "regexp_replace(p, '^0+(?=[0-9])', '')"
    return f"forall(split({t}, '[.]', -1), p -> length({short}) <= 3 and coalesce(try_cast({short} as int), 999) <= 255)"


def _holds(kind: str, t: str, left: str) -> str:
    """Whether a proposal is of its kind once loose notation is undone; ``left`` is the text before it."""
    d = _digits(t)
    if kind == "email":  # blanks stand on both sides of a dot or on none, else it ends a sentence
        at = f"regexp_replace({t}, {_quoted(_AT)}, '@')"
        dot = f"regexp_replace({at}, {_quoted(_DOT)}, '.')"
        return f"{dot} rlike {_quoted(_ADDRESS)}"
    if kind == "ip":
        return _octets(f"replace({t}, ' ', '')")
    if kind == "card":
        return _valid(kind, t)
    return f"{_valid(kind, t)} and ({t} like '+%' or {left} rlike {_quoted(_PHONE_CUE)})"


def _valid(kind: str, t: str) -> str:
    return {"email": "true", "ip": _octets(t), "card": f"if(length({_digits(t)}) between 13 and 19, {_luhn(_digits(t))}, false)",
            "phone": f"length({_digits(t)}) between 9 and 15"}[kind]


def with_matches(df: DataFrame, name: str, pattern: str, needs: str) -> DataFrame:
    """Add all leftmost matches in ``text`` as ``array<struct<start, stop, text>>``, in code points.

    Every step is a column of its own, so the pattern runs over a text twice and not more.
    The running sums are made in blocks of 256 matches, so their cost stays near linear
    in the number of matches of a text.
    """
    empty = "cast(array() as array<struct<start:bigint,stop:bigint,text:string>>)"
    step = ("named_struct('p', a.p + x.g + x.n, 'o', concat(a.o, array(named_struct('start', a.p + x.g, 'stop', a.p + x.g + x.n, 'text', x.m))))")
    steps = {
        "f": f"if({needs}, regexp_extract_all(text, {_quoted(pattern)}, 0), cast(array() as array<string>))",
        "g": f"if({needs} and size({name}_f) > 0, split(text, {_quoted(pattern)}, -1), cast(array() as array<string>))",
        "z": f"zip_with(slice({name}_g, 1, size({name}_f)), {name}_f, (g, m) -> "
             "named_struct('g', cast(char_length(g) as bigint), 'n', cast(char_length(m) as bigint), 'm', m))",
        "b": f"if(size({name}_z) = 0, cast(array() as array<array<struct<g:bigint,n:bigint,m:string>>>), "
             f"transform(sequence(0, cast((size({name}_z) - 1) div 256 as int)), b -> slice({name}_z, b * 256 + 1, 256)))",
        "p": f"aggregate(transform({name}_b, b -> aggregate(b, 0L, (a, x) -> a + x.g + x.n)), array(0L), (a, n) -> concat(a, array(element_at(a, -1) + n)))",
    }
    keep = df.columns
    for key, sql in steps.items():
        df = df.withColumn(f"{name}_{key}", F.expr(sql))
    placed = (f"flatten(zip_with({name}_b, slice({name}_p, 1, size({name}_b)), (b, p) -> "
              f"aggregate(b, named_struct('p', p, 'o', {empty}), (a, x) -> {step}, a -> a.o)))")
    return df.select(*keep, F.expr(placed).alias(name))


def with_base(df: DataFrame) -> DataFrame:
    """Add ``base``: the valid strict matches of ``text`` by kind, then start."""
    keep, parts = df.columns, []
    for i, kind in enumerate(KINDS):
        needs = f"contains(text, '{NEEDS[kind]}')" if NEEDS[kind] else "text rlike '[0-9]'"
        df = with_matches(df, f"m_{kind}", BASE[kind], needs)
        parts.append(f"transform(filter(m_{kind}, x -> {_valid(kind, 'x.text')}), x -> cast(named_struct('kind', {i}, 'start', x.start, 'stop', x.stop) as {SPAN}))")
    return df.select(*keep, F.expr(f"concat({', '.join(parts)})").alias("base"))


def with_candidates(df: DataFrame, labels: bool = False) -> DataFrame:
    """Add ``candidates``: all proposals with their features, and whether each ``holds`` what it looks like."""
    keep, parts = df.columns, []
    some = lambda c: f"(length(x.text) - length(replace(x.text, '{c}', '')))"
    d, left = _digits("x.text"), f"substring(text, cast(greatest(x.start - {CONTEXT} + 1, 1) as int), cast(least(x.start, {CONTEXT}) as int))"
    flag = lambda c: f"if(coalesce({c}, false), 1, 0)"
    for i, (kind, pattern) in enumerate(LOOSE):
        needs = r"text rlike r'@|at[)\]]'" if kind == "email" else "text rlike '[0-9]'"
        df = with_matches(df, f"l_{i}", pattern, needs)
        values = {"kind": str(KINDS.index(kind)), "length": "length(x.text)", "digits": f"length({d})", "dots": some("."), "dashes": some("-"),
                  "blanks": some(" "), "parens": f"{some('(')} + {some(')')}", "plus": some("+"), "at": some("@"),
                  "letters": "length(regexp_replace(x.text, '[^A-Za-z]', ''))", "groups": "size(split(x.text, '[^0-9]+'))",
                  "luhn": flag(f"if(length({d}) between 13 and 19, {_luhn(d)}, false)"), "octets": flag(_octets("replace(x.text, ' ', '')")),
                  "left_alnum": flag(f"{left} rlike '[A-Za-z0-9]$'"), "right_alnum": flag("substring(text, cast(x.stop + 1 as int), 1) rlike '[A-Za-z0-9]'"),
                  "cue": flag(f"{left} rlike {_quoted(_CUE)}"), "phone_cue": flag(f"{left} rlike {_quoted(_PHONE_CUE)}")}
        fields = ", ".join(f"'{k}', double({v})" for k, v in values.items()) + f", 'holds', coalesce({_holds(kind, 'x.text', left)}, false)" * labels
        parts.append(f"transform(l_{i}, x -> named_struct('start', x.start, 'stop', x.stop, {fields}))")
    return df.select(*keep, F.expr(f"concat({', '.join(parts)})").alias("candidates"))


# ---- boosted trees ----------------------------------------------------------------

def _tree(node, of: str) -> str:
    """A tree of the trained model as nested SQL conditions over a candidate."""
    if node.subtreeDepth() == 0:
        return f"{float(node.prediction())!r}D"
    split = node.split()
    return (f"if({of}{FEATURES[split.featureIndex()]} <= {float(split.threshold())!r}D, "
            f"{_tree(node.leftChild(), of)}, {_tree(node.rightChild(), of)})")


def margin(model, of: str = "c.") -> str:
    """The boosted margin of a candidate as SQL."""
    return " + ".join(f"{float(w)!r}D * {_tree(t._call_java('rootNode'), of)}" for w, t in zip(model.treeWeights, model.trees))


def labelled(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``label``, an evenly spread ``key`` and the features of every candidate that may be added, of all documents.

    Candidates over a base span of their kind are never added, so they teach nothing and
    lend no threshold their precision.
    """
    x = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    x = with_candidates(with_base(x), labels=True).select("id", "base", F.explode("candidates").alias("c"))
    x = x.where("not exists(base, b -> b.kind = c.kind and b.start < c.stop and c.start < b.stop)")
    key = hash_key(F.col("id"), F.col("c.start"), F.col("c.stop"), F.col("c.kind"))
    return x.select(F.expr("double(c.holds)").alias("label"), key.alias("key"), *[F.col(f"c.{f}").alias(f) for f in FEATURES])


def sampled(x: DataFrame, rows: int = SAMPLE_CANDIDATES) -> DataFrame:
    """At most ``rows`` candidates of each kind, those of the least keys; equal rows count once."""
    found = {int(r["kind"]): r["n"] for r in x.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a kind
    parts = []
    for kind, n in sorted(found.items()):
        some = x.where(F.col("kind") == kind)
        if n > rows:  # few more than needed go on to be ordered
            some = some.where(F.col("key") < int(min(1.0, 1.5 * rows / n) * (1 << 60)))
        parts.append(some.dropDuplicates(["key", *FEATURES]).orderBy("key", *FEATURES).limit(rows))
    out = parts[0] if parts else x
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id"):
    """``(margin SQL, {kind: threshold})``, or None without good candidates.

    Every kind has trees of its own, from ``SAMPLE_CANDIDATES`` candidates at most; the thresholds are
    calibrated on the candidates of all documents.
    """
    every = stored(labelled(docs, text_col, id_col))
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(stored(sampled(every)))
    margins, limits = {}, {}
    for r in x.groupBy("kind").agg(F.min("label").alias("low"), F.max("label").alias("high")).collect():  # one row a kind
        kind = int(r["kind"])
        if r["low"] == r["high"]:  # nothing to tell apart
            margins[kind] = lambda of, v=2 * r["high"] - 1: f"{v!r}D"
        else:
            model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=3, maxBins=32).fit(
                x.where(F.col("kind") == kind).select("label", "features"))
            margins[kind] = lambda of, m=model: margin(m, of)
    if not margins:
        return None
    sql = lambda of: "case " + " ".join(f"when {of}kind = {k} then {m(of)}" for k, m in sorted(margins.items())) + " end"
    bins = every.groupBy("kind", F.floor(F.expr(sql("")) * 4).alias("bin")).agg(F.sum("label").alias("hit"), F.count(F.lit(1)).alias("n"))
    by_kind: dict[int, list] = {}
    for r in bins.collect():  # a few dozen rows
        by_kind.setdefault(int(r["kind"]), []).append((r["bin"], r["hit"], r["n"]))
    for kind, got in by_kind.items():
        hits = n = 0
        for b, h, m in sorted(got, reverse=True):  # the lowest margin above which enough candidates are right
            hits, n = hits + h, n + m
            if hits >= PRECISION * n:
                limits[kind] = b / 4
    return f"({sql('c.')})", limits


def find(docs: DataFrame, trained=None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, text, base, spans)``; ``base`` and ``spans`` are ``array<struct<kind, start, stop>>``."""
    x = with_base(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    if trained is None or not trained[1]:
        return x.withColumn("spans", F.col("base"))
    sql, limits = trained
    limit = "case " + " ".join(f"when c.kind = {k} then {float(v)!r}D" for k, v in limits.items()) + " else 1e18D end"
    x = with_candidates(x).withColumn("more", F.expr(
        f"transform(filter(candidates, c -> {sql} >= {limit}), c -> cast(named_struct('kind', int(c.kind), 'start', c.start, 'stop', c.stop) as {SPAN}))"))
    new = "filter(more, c -> not exists(base, b -> b.kind = c.kind and b.start < c.stop and c.start < b.stop))"
    return x.select("doc_id", "text", "base", F.expr(f"array_sort(array_distinct(concat(base, {new})))").alias("spans"))


def written(spans: str) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.stop)), ',')")


def redacted(found: DataFrame) -> DataFrame:
    """``doc_id, text`` with every span of ``find`` replaced by its kind in angle brackets."""
    names = ", ".join(f"'<{k}>'" for k in KINDS)
    step = (f"if(s.start < a.p, named_struct('o', a.o, 'p', greatest(a.p, s.stop)), named_struct('o', concat(a.o, substring(text, int(a.p + 1), "
            f"int(s.start - a.p)), element_at(array({names}), s.kind + 1)), 'p', s.stop))")
    order = "array_sort(transform(spans, s -> named_struct('start', s.start, 'stop', s.stop, 'kind', s.kind)))"
    x = found.withColumn("_d", F.expr(f"aggregate({order}, named_struct('o', '', 'p', 0L), (a, s) -> {step})"))
    return x.select("doc_id", F.expr("concat(_d.o, substring(text, int(_d.p + 1)))").alias("text"))


def personal_data(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans and all spans of every row."""
    x = find(docs, fit(docs, text_col, id_col), text_col, id_col)
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return x.select("doc_id", *count, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
