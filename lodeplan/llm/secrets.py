"""Secret scans over an incremental blob ledger (operator 3).

Every historical version of every path is addressed by the SHA-256 of its content.  The ledger holds,
for each blob, which versions of which rules have scanned it and what they found; only pairs of a blob
and a rule version that it lacks are scanned, each blob once however many paths share it, and the
findings are joined back to all paths.  A changed rule is a new version and scans everything again; a
changed file is a new blob.

All of it is DataFrame operations.  A match's place is the length of what the pattern splits off before
it plus the matches before it, a running sum over the matches of one blob.  Copies are combined before
the shuffle; the join back to paths carries an address each, and blobs of many paths are dealt out by a salt.

Edge cases: null is the empty text, which is a blob like others; texts of any length are scanned whole;
repeated rows and rows with null ids are paths of their own; an empty table gives no rows; other
columns of the input may be carried by name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """pattern matches leftmost and without overlap; a match counts if the group has min_length code points.
    guards: texts without any of these, in lower case, have no match."""

    name: str
    version: int
    pattern: str
    group: int = 0
    min_length: int = 0
    guards: tuple[str, ...] = ()

    @property
    def id(self) -> str:
        return f"{self.name}@{self.version}"


#: The second and third match greedily, so the least length can be part of the pattern.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", guards=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _matches(rule: Rule, text: Column, low: Column, seen: Column) -> Column:
    """(rule, i, gap, size, value) of each match; gap: code points since the match before."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x)).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x)).alias("value"),
    )
    found = F.transform(F.filter(zipped, lambda x: x["size"].isNotNull()), lambda x, i: F.struct(F.lit(rule.id).alias("rule"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")))
    wanted = ~F.array_contains(seen, rule.id)
    if rule.guards:
        some = F.lit(False)
        for guard in rule.guards:
            some = some | F.contains(low, F.lit(guard))
        wanted = wanted & some
    return F.when(wanted, found).otherwise(F.array().cast("array<struct<rule:string,i:int,gap:int,size:int,value:int>>"))


def scan(versions: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at this path lacks, add it there, and return the ledger: blob, scanned (rule ids),
    rule, start, end; rule is null where a scan of the blob found nothing."""
    spark = versions.sparkSession
    blobs = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    past = spark.read.parquet(ledger) if common.exists(spark, ledger) else None
    if past is None:
        fresh = blobs.dropDuplicates(["blob"]).withColumn("seen", F.array().cast("array<string>"))
    else:
        done = past.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("seen"))
        needed = blobs.join(done, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        fresh = needed.where(~F.forall(F.array(*(F.lit(r.id) for r in rules)), lambda r: F.array_contains(F.col("seen"), r))).dropDuplicates(["blob"])
    fresh = fresh.withColumn("low", F.lower("text"))
    every = F.array(*(F.lit(r.id) for r in rules))
    arrays = F.concat(*(_matches(r, F.col("text"), F.col("low"), F.col("seen")) for r in rules))
    rows = fresh.select("blob", F.array_except(every, "seen").alias("scanned"), F.explode_outer(arrays).alias("m")).select("blob", "scanned", "m.*")
    before = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("bigint") + F.col("size")).over(before)
    least = F.lit(0)
    for rule in rules:
        least = F.when(F.col("rule") == rule.id, rule.min_length).otherwise(least)
    placed = rows.withColumn("end", end).withColumn("counts", F.col("value") >= least)
    placed.select("blob", "scanned", F.when(F.col("counts"), F.col("rule")).alias("rule"), F.when(F.col("counts"), F.col("end") - F.col("size")).alias("start"), F.when(F.col("counts"), F.col("end")).alias("end")).write.mode("append").parquet(ledger)
    return spark.read.parquet(ledger)


def findings(versions: DataFrame, ledger: DataFrame, carry: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """carry, blob and spans (start, place of the rule, end, kind) in that order, for every row of versions;
    underscores are appended to the last two where carry has such columns."""
    kinds = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.id, k)))
    names = F.array(*(F.lit(r.name) for r in rules))
    place = F.element_at(kinds, F.col("rule"))
    found = ledger.where(F.col("rule").isin([r.id for r in rules])).select("blob", F.struct("start", place.alias("k"), "end", F.get(names, place).alias("kind")).alias("s"))
    blob, spans = (common.free_name(versions.select(*carry), n) for n in ("blob", "spans"))
    by_blob = found.groupBy(F.col("blob").alias(blob)).agg(F.array_sort(F.collect_set("s")).alias(spans))
    paths = common.keep(versions.select(*carry, address(F.col(text)).alias(blob)), "paths")
    sizes = paths.groupBy(blob).agg(F.count(F.lit(1)).alias("n"))
    empty = F.array().cast(by_blob.schema[spans].dataType)
    return common.join_hot(paths, by_blob, [blob], sizes, "left").select(*carry, blob, F.coalesce(spans, empty).alias(spans))


def digests(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    path = ledger or common.scratch(docs.sparkSession, "ledger")
    found = findings(docs, scan(docs, path), ["doc_id"])

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == name)).cast("bigint").alias(f"n_{name}")

    counts = [count(r.name) for r in RULES]
    joined = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *counts, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))
