"""Secret scans over a ledger of content-addressed blobs.

Every version of every document is addressed by the SHA-256 of its text.  A
ledger row says which rule versions a blob was scanned with and what they found.
``scan`` compares the blobs at hand with the ledger, scans only the unseen pairs
of blob and rule version, appends them, and joins the ledger's findings back to
all rows (paths) that hold the blob.  Without a ledger's path a new one is begun
in the scratch folder.

Ledger rows name rules by kind and version, so rules may be added, changed or
reordered.  Spans are code points, end exclusive.  The first three rules are the
base; a later rule adds spans and never removes any.

Defined results: a null text is the empty text and has no findings; equal texts
share one blob, however many rows hold them; spans that begin alike follow the
order of the rules; an empty table gives empty results; other columns, whatever
their names, are not touched.  A ledger row that was appended twice (by runs at
the same time, or after a failure) counts once.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.llm.common import prepare, rows_in_slices, scratch_path, text_or_empty

LEDGER = "blob string, rules array<string>, findings array<struct<start:int,end:int,rule:string>>"
FINDINGS = "array<struct<start:int,place:int,end:int,rule:string>>"
#: A session setting that names a lasting ledger for the queries.
SETTING = "spark.coterie.ledger"

#: Fixed values.  (kind, version, pattern, group whose length counts, least length); a failing match is dropped.
RULES = (
    ("assign", 1, r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    ("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", 0, 20),
    ("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("git_token", 1, r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", 0, 26),
    ("url_password", 1, r"(?<=://)[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+,;=-]{6,}(?=@[A-Za-z0-9])", 0, 8),
)
BASE = ("assign", "access", "hex")
#: A literal that each costly rule needs; texts without it are not searched.
NEEDS = {"access": "AKIA", "private_key": "PRIVATE KEY-----", "jwt": "eyJ", "url_password": "://"}


def rule_names(rules=RULES) -> list[str]:
    return [f"{kind}@{version}" for kind, version, *_ in rules]


def find(text: str, rules=RULES) -> list[tuple[int, int, int, str]]:
    """``(start, place of the kind, end, rule)`` sorted; leftmost and non-overlapping for each kind."""
    out = []
    for place, (kind, version, pattern, group, least) in enumerate(rules):
        if kind in NEEDS and NEEDS[kind] not in text:
            continue
        for m in compiled(pattern)(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), place, m.end(), f"{kind}@{version}"))
    return sorted(out)


_COMPILED: dict = {}


def compiled(pattern: str):
    if pattern not in _COMPILED:
        _COMPILED[pattern] = re.compile(pattern).finditer
    return _COMPILED[pattern]


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows for ``blob, text, todo`` (the rule versions to run on that blob)."""
    prepare(blobs.sparkSession)
    places = {name: i for i, name in enumerate(rule_names(rules))}
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rule", pa.string())])

    def run(batches):
        for whole in batches:
            for batch in rows_in_slices(whole, "text"):
                todo = batch.column(2).to_pylist()
                found = []
                for text, names in zip(batch.column(1).to_pylist(), todo, strict=True):
                    wanted = tuple(rules[places[x]] for x in names)
                    found.append([{"start": start, "end": end, "rule": rule} for start, _, end, rule in find(text, wanted)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(todo, pa.list_(pa.string())), pa.array(found, pa.list_(item))], ["blob", "rules", "findings"])

    return blobs.select("blob", "text", "todo").mapInArrow(run, LEDGER)


def blobs_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """``blob, text``: each distinct text once, copies collapsed before the shuffle."""
    texts = docs.select(text_or_empty(text).alias("text"))
    return texts.select(F.sha2("text", 256).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))


def open_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger table at ``path``, or None before the first scan."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """``blob, text, todo``: the blobs that lack a rule version in the ledger, and the rule versions that they lack."""
    wanted = F.array(*map(F.lit, rule_names(rules)))
    if ledger is None:
        return blobs.select("blob", "text", wanted.alias("todo"))
    # only the rows of blobs at hand; a blob has one row for each scan that found it unseen
    known = ledger.select("blob", "rules").join(blobs.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    lacks = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(known, "blob", "left").select("blob", "text", lacks.alias("todo")).where(F.size("todo") > 0)


def findings_of(ledger: DataFrame, rules=RULES) -> DataFrame:
    """``blob, findings`` of the blobs in which a current rule version found something, in order."""
    wanted = F.array(*map(F.lit, rule_names(rules)))
    now = F.filter("findings", lambda x: F.array_contains(wanted, x["rule"]))
    # equal ledger rows are one row; a blob's findings are bounded by its text
    rows = ledger.select("blob", now.alias("findings")).where(F.size("findings") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("findings"))).alias("findings"))
    placed = F.transform("findings", lambda x: F.struct(x["start"].alias("start"), (F.array_position(wanted, x["rule"]) - 1).cast("int").alias("place"), x["end"].alias("end"), x["rule"].alias("rule")))
    return rows.select("blob", F.array_sort(placed).alias("findings"))


def record(docs: DataFrame, path: str | None = None, rules=RULES, text: str = "text") -> DataFrame:
    """Scan what the ledger at ``path`` lacks, append it, and return the ledger."""
    spark = docs.sparkSession
    path = path or spark.conf.get(SETTING, None) or scratch_path(spark, "ledger")
    scan_blobs(unseen(blobs_of(docs, text), open_ledger(spark, path), rules), rules).write.mode("append").parquet(path)
    return open_ledger(spark, path)


def scan(docs: DataFrame, path: str | None = None, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, blob, findings`` for every row of ``docs``, by way of the ledger at ``path``."""
    found = findings_of(record(docs, path, rules, text), rules)
    paths = docs.select(F.col(key).alias("key"), F.sha2(text_or_empty(text), 256).alias("blob"))
    none = F.array().cast(FINDINGS)
    return paths.join(found, "blob", "left").select(F.col("key").alias(key), "blob", F.coalesce("findings", none).alias("findings"))


def kind(finding: Column) -> Column:
    return F.substring_index(finding["rule"], "@", 1)


def joined(findings: Column) -> Column:
    """``kind:start:end`` of each finding in order, comma-joined."""
    return F.concat_ws(",", F.transform(findings, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))))


def cut_out(text: Column, findings: Column, mark: str) -> Column:
    """``text`` with every span replaced by ``mark``; spans that overlap one before them are cut with it."""

    def step(done: Column, x: Column) -> Column:
        fresh = F.concat(done["out"], F.substring(text, done["at"] + 1, x["start"] - done["at"]), F.lit(mark))
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"), F.when(x["start"] >= done["at"], fresh).otherwise(done["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(findings, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text))))


def redact(docs: DataFrame, path: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; ``n_chars`` follows, other columns stay.

    Blobs are scanned by way of the ledger, as in ``scan``.
    """
    dirty = findings_of(record(docs, path)).withColumnsRenamed({"blob": "__coterie_blob", "findings": "__coterie_found"})
    out = docs.withColumn("__coterie_blob", F.sha2(text_or_empty(), 256)).join(dirty, "__coterie_blob", "left")
    out = out.withColumn("__coterie_clean", F.when(F.col("__coterie_found").isNotNull(), cut_out(F.col("text"), F.col("__coterie_found"), mark)))
    clean = F.col("__coterie_clean")
    columns = {"text": F.coalesce(clean, F.col("text")).alias("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(clean.isNotNull(), F.char_length(clean)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[columns.get(c, F.col(f"`{c}`")) for c in docs.columns])
