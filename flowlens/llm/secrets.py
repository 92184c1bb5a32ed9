"""Secret scans over an incremental blob ledger.

Every historical version of a text is addressed by its content (SHA-256).  The
ledger, a Parquet table in a shared folder, records for each blob which rule
versions have been run and what they found.  A scan reads only blobs with a
rule version that the ledger lacks, runs only those rules on them, appends the
outcome, and joins the findings back to every row that holds the blob.

Everything is DataFrame expressions; a span's place comes from the lengths of
the gaps and matches that one anchored pattern splits a text into.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import free_name
from flowlens.session import scratch_path


def either_case(word: str) -> str:
    """Pattern for an ASCII word in any case, the same in every regex dialect."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """One kind of secret.  ``pattern`` matches leftmost and non-overlapping;
    its only capturing group must hold ``least`` characters or the match is
    dropped.  ``hint`` matches every text with a kept match.  ``lead``, which
    may be empty, is read before a match and must not change which matches
    there are; it keeps hopeless starts from being tried.  A changed rule gets
    a new version and is run anew over all blobs."""

    kind: str
    version: int
    pattern: str
    least: int
    hint: str
    lead: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    @property
    def split(self) -> str:
        """Gap, match and measured group, each match anchored at the last end."""
        return rf"\G([\s\S]*?{self.lead})({self.pattern})"


_KEYWORD = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) \
    + f"|{either_case('api')}_?{either_case('key')}"
_ASSIGN = rf"""(?:{_KEYWORD})["']?\x20*[:=]\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]"
_RUN = "[A-Za-z0-9_-]+"

#: Kinds in output order: first the base kinds, then those the ledger adds.
RULES: tuple[Rule, ...] = (
    Rule("assign", 1, rf"{_ASSIGN}({_VALUE}+)", 6, rf"{_ASSIGN}{_VALUE}{{6}}"),
    Rule("access", 1, "(AKIA[A-Z0-9]+)", 20, "AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, "([0-9a-f]+)", 24, "[0-9a-f]{24}"),
    Rule("pem", 1, "(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 0, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", 1, "(gh[pousr]_[A-Za-z0-9]+)", 40, "gh[pousr]_[A-Za-z0-9]{36}"),
    # a run of word characters is looked at once, from its start: its first eyJ matches or none of its eyJ does
    Rule("jwt", 1, rf"(eyJ{_RUN}\.eyJ{_RUN}\.{_RUN})", 30, rf"{_RUN[:-1]}\.eyJ{_RUN}\.{_RUN[:-1]}",
         rf"(?<!{_RUN[:-1]})(?={_RUN}+\.eyJ{_RUN}+\.{_RUN[:-1]}){_RUN[:-1]}*?"),
)
#: Characters of a text that are read to find a place in it when it is cut.
CHUNK = 1024
BASE_KINDS = ("assign", "access", "hex")
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column, add: Callable[[Column, Column], Column] = operator.add) -> Column:
    """Running sums of an array of integers (or, with ``F.greatest`` for ``add``,
    running maxima of integers from 0 up).  Sums grow inside blocks of about
    sqrt(n) values and the blocks' offsets are added, since an array is copied
    whenever a value is appended: n * sqrt(n) copies, where one block needs n * n."""
    def grow(items: Column, size: Callable[[Column], Column]) -> Column:
        """Sums before each item, then the sum of all."""
        return F.aggregate(
            items, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), size(x)))))

    def blocks(values: Column, width: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(values), width)
        return F.transform(starts, lambda at: grow(F.slice(values, at, width), lambda x: x))

    def shifted(inner: Column) -> Column:
        offsets = F.slice(grow(inner, lambda b: F.element_at(b, -1)), F.lit(1), F.size(inner))
        zipped = F.arrays_zip(inner.alias("inner"), offsets.alias("offset"))
        return F.flatten(F.transform(zipped, lambda z: F.transform(
            F.slice(z["inner"], F.lit(2), F.size(z["inner"]) - 1), lambda x: add(x, z["offset"]))))

    width = F.ceil(F.sqrt(F.size(values))).cast("int")
    sums = bound(F.struct(values.alias("v"), width.alias("w")), lambda p: bound(blocks(p["v"], p["w"]), shifted))
    return F.when(F.size(values) > 0, sums).otherwise(F.array().cast("array<int>"))


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in a text, in code points, end exclusive."""
    gap, match, measured = (F.regexp_extract_all(text, F.lit(rule.split), F.lit(i)) for i in (1, 2, 3))
    sizes = F.transform(
        F.arrays_zip(gap.alias("gap"), match.alias("match"), measured.alias("held")),
        lambda p: F.struct((F.length(p["gap"]) + F.length(p["match"])).alias("step"),
                           F.length(p["match"]).alias("size"), F.length(p["held"]).alias("held")))

    def placed(sizes: Column) -> Column:
        ends = running_sums(F.transform(sizes, lambda p: p["step"]))
        kept = F.filter(F.arrays_zip(sizes.alias("part"), ends.alias("end")),
                        lambda z: z["part"]["held"] >= rule.least)
        return F.transform(kept, lambda z: F.struct(
            (z["end"] - z["part"]["size"]).alias("start"), F.lit(rank).alias("rank"),
            z["end"].alias("end"), F.lit(rule.kind).alias("kind")))

    return F.when(text.rlike(rule.hint), bound(sizes, placed)).otherwise(F.array().cast(_SPANS))


def content_address(text: Column) -> Column:
    """The blob's name: SHA-256 of the text; null reads as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger's rows (blob, rules, findings), or None before the first scan."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if files.exists(place) else None


def scan_unseen(docs: DataFrame, ledger: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the blobs of ``docs`` for the rule versions the ledger lacks, and
    append one row a blob: (blob, rules run, findings)."""
    spark = docs.sparkSession
    wanted = F.array(*(F.lit(r.key) for r in rules))
    blobs = docs.select(content_address(F.col(text_col)).alias("blob"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")).dropDuplicates(["blob"])
    seen = read_ledger(spark, ledger)
    if seen is None:
        todo = blobs.withColumn("rules", wanted)
    else:
        done = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("done"))
        todo = blobs.join(done, "blob", "left").withColumn(
            "rules", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))) \
            .where(F.size("rules") > 0)
    found = F.concat(*(
        F.when(F.array_contains("rules", r.key), rule_spans(F.col("body"), r, i))
        .otherwise(F.array().cast(_SPANS)) for i, r in enumerate(rules)))
    todo.select("blob", "rules", found.alias("findings")).write.mode("append").parquet(ledger)


def find_secrets(docs: DataFrame, ledger: str | None = None, text_col: str = "text",
                 rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Documents with the secrets of their whole texts.

    Returns the frame (columns ``keep``, all by default, plus one) and the
    name of the one: an array of (start, rank, end, kind), sorted by start and
    then by the rule's place in ``rules``.  ``ledger`` is the ledger's folder,
    shared by all executors; without one the scan starts from an empty ledger.

    Null texts read as empty and hold nothing; repeated rows each get a row;
    identical texts are scanned once and all get the findings; an empty table
    gives an empty table.  A very long text is scanned whole, in time in
    proportion to it but for the sums over n matches (n * sqrt(n) steps).
    """
    spark = docs.sparkSession
    ledger = ledger or scratch_path(spark, "blob-ledger")
    keep = docs.columns if keep is None else keep
    scan_unseen(docs, ledger, text_col, rules)
    current = {r.kind: i for i, r in enumerate(rules)}
    ours = read_ledger(spark, ledger).where(F.size("findings") > 0)
    # a rule's old version stays in the ledger; only findings of the current versions count
    keys = {r.kind: r.key for r in rules}
    fresh = F.filter("findings", lambda s: F.array_contains("rules", F.create_map(
        *(F.lit(x) for kv in keys.items() for x in kv))[s["kind"]]) & s["kind"].isin(*current))
    name, blob, at = free_name(docs, "secrets"), free_name(docs, "blob"), free_name(docs, "blob_found")
    found = ours.select(F.col("blob").alias(at), fresh.alias("f")).groupBy(at).agg(
        F.sort_array(F.flatten(F.collect_list("f"))).alias("all"))
    # two scans at once may both have run a rule; array_distinct would compare every span with every other
    found = found.select(at, bound(F.col("all"), lambda spans: F.filter(
        spans, lambda s, i: ~s.eqNullSafe(F.get(spans, i - 1)))).alias(name))
    rows = docs.select(*keep, content_address(F.col(text_col)).alias(blob))
    joined = rows.join(found, F.col(blob) == F.col(at), "left")
    return joined.select(*keep, F.coalesce(name, F.array().cast(_SPANS)).alias(name)), name


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of the spans in their order, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _between(chunks: Column, lo: Column, hi: Column) -> Column:
    """Characters lo to hi of a text in chunks, which are read from their near ends."""
    first = F.floor(lo / CHUNK).cast("int")
    held = F.slice(chunks, first + 1, F.floor((hi - 1) / CHUNK).cast("int") - first + 1)
    return F.when(hi > lo, F.array_join(held, "").substr(lo % CHUNK + 1, hi - lo)).otherwise("")


def _cut(text: Column, spans: Column) -> Column:
    """The text with ``[kind]`` for every stretch of overlapping spans, of the first of them.

    A stretch begins where a span starts at or after the running maximum of the
    ends before it, which is the end of the stretch before: each gap is known
    without its predecessors."""
    def cut(p: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), p["upto"])  # one longer: its last is the end of all
        opens = F.filter(F.arrays_zip(p["spans"].alias("span"), F.slice(before, F.lit(1), F.size(p["spans"])).alias("at")),
                         lambda z: z["span"]["start"] >= z["at"])
        parts = F.transform(opens, lambda z: F.concat(
            _between(p["chunks"], z["at"], z["span"]["start"]), F.lit("["), z["span"]["kind"], F.lit("]")))
        return F.concat(F.array_join(parts, ""), _between(p["chunks"], F.element_at(p["upto"], -1), p["length"]))

    return bound(F.struct(
        F.regexp_extract_all(text, F.lit(rf"([\s\S]{{1,{CHUNK}}})"), F.lit(1)).alias("chunks"), spans.alias("spans"),
        running_sums(F.transform(spans, lambda s: s["end"]), F.greatest).alias("upto"),
        F.length(text).alias("length")), cut)


def redact(docs: DataFrame, ledger: str | None = None, text_col: str = "text",
           rules: tuple[Rule, ...] = RULES, size_col: str | None = "n_chars") -> DataFrame:
    """The documents with every secret replaced by ``[kind]``; of overlapping
    secrets the first names the cut.  ``size_col``, where the table has it,
    follows the new text.  Rows without a secret, null and empty texts among
    them, stay as they are; an empty table gives an empty table.  A very long
    text is cut whole, in time in proportion to its length and its secrets (and
    to n * sqrt(n) for n secrets)."""
    found, spans = find_secrets(docs, ledger, text_col, rules)
    cut = _cut(F.col(text_col), F.col(spans))
    text = F.col(text_col)
    new = free_name(found, "redacted")  # its own column first: a second use of the name would see the new text
    found = found.withColumn(new, F.when(F.size(spans) > 0, cut).otherwise(text))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col(new).alias(c))
        elif c == size_col:
            columns.append(F.when(F.size(spans) > 0, F.length(new).cast(docs.schema[c].dataType))
                           .otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return found.select(*columns)
