"""Personal data by candidate spans and gradient boosting, in DataFrame functions alone.

Generators propose spans of four kinds: the strict forms, and loose ones (hidden mail
addresses, numbers without a country code, other separators). The spans of a text stay
in its row as an array, with a code: the shape of the span and its surroundings in a few
small classes. Strict forms are their own labels, as their check (part sizes, Luhn,
number of digits) passes or fails; it is not part of the code. Counts by code over all
documents train boosted trees on one half of the documents. The other half sets the
threshold of each kind: the lowest score from which on enough candidates pass.

Spans of the strict forms that pass their check always stay. A loose span is added if
it passes the check, its code reaches the threshold, and it touches no strict span.
Nothing is shuffled but the counts, of which there are at most ``CODES`` a half and outcome.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm.tables import stored

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The strict forms. Possessive repeats and the look behind leave the matches as they are and keep
# long runs of one kind of character linear; \G lets a match begin where the last one ended.
STRICT = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?+[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: What a text must hold for the strict form to be looked for.
STRICT_NEEDS = (r"@", r"[0-9]\.[0-9]", r"[0-9](?:[\x20-]?+[0-9]){11}", r"\+[0-9]")

_AT, _DOT = r"\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?", r"\x20?[\[({]\x20?(?i:dot)\x20?[\])}]\x20?"
#: ``(kind, pattern, what a text must hold)`` of the loose forms.
LOOSE = (
    (EMAIL, rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)++", _AT),
    (IP, r"(?<![0-9.])[0-9]{1,9}+(?:\[\.\][0-9]{1,9}+){3}(?![0-9])", r"\[\.\]"),
    (CARD, r"(?<![0-9A-Za-z./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9A-Za-z])", r"[0-9]{4}[./_][0-9]{4}"),
    (
        PHONE,
        r"(?<![0-9A-Za-z+(./_-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z_-]|\.[0-9])",
        r"[0-9]{3}[\x20.-][0-9]{4}",
    ),
    (
        PHONE,
        r"(?<![0-9A-Za-z+(./_-])00[1-9][\x20().0-9-]{7,20}[0-9](?![0-9A-Za-z_-])",
        r"00[1-9][\x20().0-9-]{7}",
    ),
)

_NEAR = (
    r"mail|contact|write|reach",
    r"\bip\b|host|addr|server|login|client",
    r"card|visa|credit|debit|pay",
    r"phone|\btel|call|fax|mobile|\bcell",
)
_DECOY = r"version|isbn|order|invoice|serial|build|release|\bitem|\bpart\b|\bref\b|\bsku\b|\bdoi\b|\bfig|section"
#: Characters before a span that are looked at.
BEFORE = 40

_DIGIT_CLASS = (0, 1, 1, 1, 1, 1, 1, 2, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10)
#: Number of classes of each feature, most significant first in a code.
RADIX = {"kind": 4, "digits": 11, "groups": 5, "lead": 10, "left": 4, "right": 4, "near": 3}
CODES = reduce(lambda a, b: a * b, RADIX.values())

TREES, DEPTH, RATE = 20, 4, 0.3
#: Share of strict candidates from the threshold on that must pass.
PRECISION = 0.98

CANDIDATE = "struct<kind:int,start:bigint,end:bigint,strict:boolean,ok:boolean,code:int>"
BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often and deep ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, first: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of ``op`` over an array of bigint, block by block, so that cost stays near its length."""

    def scan(array: Column) -> Column:
        start = F.struct(first.cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("a"))
        step = lambda acc, v: let(op(acc["s"], v), lambda x: F.struct(x.alias("s"), F.array_append(acc["a"], x).alias("a")))
        return F.aggregate(array, start, step)["a"]

    def join(inner: Column) -> Column:
        last = F.transform(inner, lambda a: F.get(a, F.size(a) - 1))
        shift = lambda all_: F.flatten(
            F.transform(
                inner,
                lambda a, i: let(F.get(all_, i - 1), lambda x: F.transform(a, lambda v: F.when(i == 0, v).otherwise(op(x, v)))),
            )
        )
        return let(scan(last), shift)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(let(F.transform(blocks, scan), join))


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<hit, before, after, end>>``: all matches, the text between them, and where each ends."""
    long = lambda c: F.length(c).cast("bigint")

    def with_ends(s: Column) -> Column:
        k = F.size(s["hits"])
        before, after = F.slice(s["gaps"], F.lit(1), k), F.slice(s["gaps"], F.lit(2), k)
        sizes = F.zip_with(before, s["hits"], lambda g, h: long(g) + long(h))
        ends = let(sizes, lambda v: running(v, F.lit(0), lambda a, b: a + b))
        return F.arrays_zip(s["hits"].alias("hit"), before.alias("before"), after.alias("after"), ends.alias("end"))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    zipped = let(both, with_ends)
    return zipped.cast("array<struct<hit:string,before:string,after:string,end:bigint>>")


def _luhn(digits: Column) -> Column:
    doubled = F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    marks = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    values = F.transform(marks, lambda c, i: let(c.cast("int"), lambda v: F.when(i % 2 == 1, F.get(doubled, v)).otherwise(v)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _passes(kind: int, hit: Column, digits: Column) -> Column:
    if kind == IP:
        return hit.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\[?\.\]?0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})){3}$")
    if kind == CARD:
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == PHONE:
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _char_class(c: Column) -> Column:
    return F.when(c.rlike(r"^\s?$"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)


def _code(kind: int, m: Column, digits: Column) -> Column:
    if kind == EMAIL:
        name = F.regexp_replace(F.regexp_replace(m["hit"], _AT, "@"), _DOT, ".")
        groups = F.length(F.regexp_replace(F.regexp_extract(name, r"@(.*)$", 1), r"[^.]", ""))
        lead = F.length(F.regexp_extract(name, r"\.([^.]*)$", 1))
    else:
        groups = F.length(F.regexp_replace(F.regexp_replace(m["hit"], r"[^0-9]++", "#"), r"[^#]", ""))
        lead = F.coalesce(F.left(digits, F.lit(1)).cast("int"), F.lit(0))
    context = F.lower(F.right(m["before"], F.lit(BEFORE)))
    near = F.when(context.rlike(_NEAR[kind]), 1).when(context.rlike(_DECOY), 2).otherwise(0)
    parts = {
        "kind": F.lit(kind),
        "digits": F.get(F.array(*[F.lit(v) for v in _DIGIT_CLASS]), F.least(F.length(digits), F.lit(len(_DIGIT_CLASS) - 1))),
        "groups": F.least(groups, F.lit(4)),
        "lead": F.least(lead, F.lit(9)),
        "left": _char_class(F.right(m["before"], F.lit(1))),
        "right": _char_class(F.left(m["after"], F.lit(1))),
        "near": near,
    }
    return reduce(lambda code, name: code * RADIX[name] + parts[name], list(RADIX)[1:], parts["kind"])


def _generated(text: Column, kind: int, pattern: str, needs: str, strict: bool) -> Column:
    """``array<CANDIDATE>`` of one generator."""

    def candidate(m: Column) -> Column:
        digits = F.regexp_replace(m["hit"], "[^0-9]", "")
        fields = lambda d: F.struct(
            F.lit(kind).alias("kind"),
            (m["end"] - F.length(m["hit"])).alias("start"),
            m["end"].alias("end"),
            F.lit(strict).alias("strict"),
            _passes(kind, m["hit"], d).alias("ok"),
            _code(kind, m, d).alias("code"),
        )
        return let(digits, fields)

    found = matches(text, pattern)
    if kind == CARD and strict:
        # Shorter numbers cannot pass, and there are many.
        found = F.filter(found, lambda m: F.length(m["hit"]) >= 12)
    needed = text.contains(needs) if needs == "@" else text.rlike(needs)
    return F.when(needed, F.transform(found, candidate).cast(f"array<{CANDIDATE}>")).otherwise(F.array().cast(f"array<{CANDIDATE}>"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, candidates array<CANDIDATE>)``, one row per input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    strict = [_generated(text, kind, STRICT[kind], STRICT_NEEDS[kind], True) for kind in range(4)]
    loose = [_generated(text, kind, pattern, needs, False) for kind, pattern, needs in LOOSE]
    return docs.select(F.col(id_col).alias("doc_id"), F.concat(*strict, *loose).alias("candidates"))


def code_counts(rows: DataFrame) -> DataFrame:
    """``(code, half, n, passed)``: strict candidates by code and half of the documents; loose codes have ``n`` 0."""
    half = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)), F.lit(0)).cast("int")
    each = rows.select(half.alias("half"), F.explode("candidates").alias("c"))
    strict = F.col("c.strict").cast("bigint")
    return each.groupBy(F.col("c.code").alias("code"), "half").agg(
        F.sum(strict).alias("n"), F.sum(strict * F.col("c.ok").cast("bigint")).alias("passed")
    )


def scored_codes(counts: DataFrame) -> DataFrame:
    """``(code, kind, score)`` of all codes, from trees boosted on the half 0; no rows if that half has no strict candidate."""
    rest, columns = F.col("code"), []
    for name in reversed(RADIX):
        columns.append(F.pmod(rest, F.lit(RADIX[name])).alias(name))
        rest = F.floor(rest / RADIX[name])
    assembler = VectorAssembler(inputCols=list(RADIX), outputCol="features")
    outcomes = F.explode(
        F.array(
            F.struct(F.lit(1.0).alias("label"), F.col("passed").cast("double").alias("weight")),
            F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("passed")).cast("double").alias("weight")),
        )
    )
    train = counts.filter("half = 0").select("code", *columns, outcomes.alias("o")).select("*", "o.label", "o.weight").filter("weight > 0")
    codes = counts.select("code").distinct().select("code", *columns)
    if train.isEmpty():
        return codes.filter("false").select("code", "kind", F.lit(0.0).alias("score"))
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, maxBins=16, seed=1
    )
    model = trees.fit(assembler.transform(train))
    done = model.transform(assembler.transform(codes))
    return done.select("code", "kind", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def thresholds(counts: DataFrame, scores: DataFrame, precision: float = PRECISION) -> DataFrame:
    """``(kind, threshold)``: the lowest score of the half 1 from which on that share of strict candidates passes."""
    rows = counts.filter("half = 1 and n > 0").join(scores, "code").groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum("passed").alias("passed"))
    from_here = Window.partitionBy("kind").orderBy(F.desc("score"))
    share = F.sum("passed").over(from_here) / (F.sum("n").over(from_here) + 1)
    return rows.select("kind", "score", share.alias("share")).filter(F.col("share") >= precision).groupBy("kind").agg(F.min("score").alias("threshold"))


def _apart(chosen: Column) -> Column:
    """Of candidates by start, the strict ones, and the loose ones that touch no strict one."""
    strict_end = F.transform(chosen, lambda c: F.when(c["strict"], c["end"]).otherwise(F.lit(-1).cast("bigint")))
    strict_start = F.transform(F.reverse(chosen), lambda c: F.when(c["strict"], -c["start"]).otherwise(F.lit(-(2**62))))

    def by_bounds(bounds: Column) -> Column:
        # The latest end of strict spans so far, and the earliest start of those to come.
        kept = F.filter(
            F.arrays_zip(chosen.alias("c"), bounds["ends"].alias("e"), F.reverse(bounds["starts"]).alias("s")),
            lambda z: z["c"]["strict"] | ((z["e"] <= z["c"]["start"]) & (-z["s"] >= z["c"]["end"])),
        )
        return F.transform(kept, lambda z: z["c"])

    latest = lambda array, first: let(array, lambda a: running(a, F.lit(first), F.greatest))
    return let(F.struct(latest(strict_end, -1).alias("ends"), latest(strict_start, -(2**62)).alias("starts")), by_bounds)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """``(doc_id, spans array<struct<kind string, start, end, strict>>)``, one row per input row.

    Spans are in code points, the end exclusive, sorted by kind (email, ip, card, phone) and start.
    ``strict`` spans are the matches of the strict forms that pass their check, found
    from left to right for each kind; the others are loose forms that the boosted trees
    select. Loose spans may overlap each other, never a strict one. Null and empty texts
    have no spans; repeated rows give a row and count each; null ids stay and belong to the
    training half. An empty table gives no rows. Where strict candidates are
    missing in a half, nothing is added to the strict spans. Other columns are not read. Texts
    are taken whole, in time proportional to their length.
    """
    rows = stored(candidates(docs, id_col, text_col))
    counts = stored(code_counts(rows))
    scores = stored(scored_codes(counts))
    chosen = scores.join(thresholds(counts, scores, precision), "kind").filter("score >= threshold").select("code")
    codes = [r["code"] for r in chosen.collect()]
    picked = F.filter("candidates", lambda c: c["ok"] & (c["strict"] | (c["code"].isin(codes) if codes else F.lit(False))))
    by_start = F.array_sort(
        F.transform(
            picked,
            lambda c: F.struct(
                c["start"].alias("start"), (~c["strict"]).alias("loose"), c["kind"].alias("kind"), c["end"].alias("end"), c["strict"].alias("strict")
            ),
        )
    )
    apart = let(by_start, lambda a: F.when(F.exists(a, lambda c: c["loose"]), _apart(a)).otherwise(a))
    listed = F.array_sort(
        F.array_distinct(
            F.transform(
                apart,
                lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["strict"].alias("strict")),
            )
        )
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(
        listed,
        lambda c: F.struct(F.get(names, c["kind"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["strict"].alias("strict")),
    )
    return rows.select("doc_id", spans.alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
