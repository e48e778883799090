"""Secret scans over all versions of files, with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text (its blob). The
ledger holds which blob was scanned under which version of the rules, and what was
found. A scan reads one text of each pair that the ledger has not seen, adds the
findings to the ledger, and joins them back to all paths and versions of a blob: a
text that a third of the corpus shares is scanned once, and a second scan reads
nothing but new texts.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm.tables import stored
from sensorframe.session import shared_folder


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count when ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False


#: The base rules, in their order.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<start:bigint,place:int,kind:string,end:bigint>>"


def version_of(rules: tuple[Rule, ...]) -> str:
    """A short digest of the rules; any change gives another."""
    return hashlib.sha256(json.dumps([vars(r) for r in rules], sort_keys=True).encode()).hexdigest()[:16]


def _compiled(rules: tuple[Rule, ...]) -> list[tuple[Rule, re.Pattern]]:
    out = []
    for rule in rules:
        pattern = rule.pattern
        if rule.group == 0 and rule.least > 1 and pattern.endswith("]+"):
            # A closing run of one class: a match that is too short holds no longer one.
            fixed = len(re.match(r"[A-Za-z0-9]*", pattern).group())
            pattern = f"{pattern[:-1]}{{{rule.least - fixed},}}"
        out.append((rule, re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))))
    return out


def spans_of(text: str, rules: tuple[Rule, ...] = RULES, compiled=None) -> list[tuple[int, int, str, int]]:
    """``(start, place of the rule, kind, end)`` in code points, by start and rule.

    Matches of one kind do not overlap and are taken from the left; a match that is
    too short is dropped after it was taken.
    """
    found = []
    for place, (rule, pattern) in enumerate(compiled or _compiled(rules)):
        for hit in pattern.finditer(text):
            if len(hit.group(rule.group)) >= rule.least:
                found.append((hit.start(), place, rule.kind, hit.end()))
    return sorted(found)


class Ledger:
    """Scanned pairs and findings in a shared folder; tables only grow."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        # The first scan makes the tables; an empty append does it without looking into the folder.
        self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def findings(self) -> DataFrame:
        """``(blob, rules, spans)``; a pair that two scans met at once may stand there twice."""
        return self._read("findings", f"blob binary, rules string, spans {SPANS}")

    def add(self, scanned: DataFrame) -> None:
        """Add ``(blob, rules, spans)`` rows; a pair is known once its row is there."""
        scanned.write.mode("append").parquet(f"{self.folder}/findings")


def new_ledger(spark: SparkSession) -> Ledger:
    return Ledger(spark, f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}")


def scan(
    versions: DataFrame, ledger: Ledger, keys: tuple[str, ...], text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``keys``, ``blob`` and ``spans`` of every version; only unseen blobs are read and scanned.

    ``keys`` name the columns that tell a version (path, commit, ...); they may be
    null or repeat, and rows come back as often as they are given. A null text is
    empty. Spans are ``(start, place, kind, end)`` in code points, in order of start
    and rule; an empty list where nothing was found. An empty table gives no rows.
    """
    mark = version_of(rules)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = versions.select(*[F.col(k) for k in keys], text.alias("__text")).withColumn(
        "blob", F.unhex(F.sha2("__text", 256))
    )
    # Any one row of a blob will do; the smallest hash of its keys names it.
    rows = rows.withColumn("__row", F.xxhash64("blob", *keys))
    known = ledger.findings().filter(F.col("rules") == mark)
    addresses = stored(rows.select(*keys, "blob", "__row"))
    chosen = addresses.groupBy("blob").agg(F.min("__row").alias("__row"))
    unseen = stored(chosen.join(known, "blob", "left_anti"))

    def run(batches):
        compiled = _compiled(rules)
        for batch in batches:
            spans = [
                [{"start": a, "place": p, "kind": k, "end": b} for a, p, k, b in spans_of(t, rules, compiled)]
                for t in batch["__text"]
            ]
            yield pd.DataFrame({"blob": batch["blob"], "rules": mark, "spans": spans})

    texts = rows.select("blob", "__row", "__text").join(unseen.hint("shuffle_hash"), ["blob", "__row"], "left_semi")
    ledger.add(texts.select("blob", "__text").mapInPandas(run, f"blob binary, rules string, spans {SPANS}"))
    found = ledger.findings().filter((F.col("rules") == mark) & (F.size("spans") > 0))
    # Repeated rows of a version may have scanned one blob twice, with the same result.
    found = found.groupBy("blob").agg(F.first("spans").alias("spans"))
    none = F.array().cast(SPANS)
    return addresses.drop("__row").join(found, "blob", "left").select(*keys, "blob", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
