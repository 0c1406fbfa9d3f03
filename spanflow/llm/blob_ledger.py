"""Secret scans over an incremental, content-addressed ledger.

Every version of every text is addressed by the sha256 of its UTF-8 bytes (a
blob).  A ledger folder holds three tables, one ``batch=`` folder an added batch:

* ``versions``: the caller's row, its path, its blob;
* ``scans``: (blob, rules): the rule versions, ``kind@version``, a blob was scanned with;
* ``findings``: (blob, rule, start, end), in code points, end exclusive.

:meth:`Ledger.add` scans each (blob, rule version) pair that is in no other batch,
once however many paths hold it; :meth:`Ledger.report` joins the findings back to
all paths.  A new version of one rule scans the known blobs with that rule only.
The batch's ``scans`` are written last, so a batch that was cut off is done again,
and adding a batch again replaces it.  Only DataFrame functions are used: places come
from the lengths of matches and of the pieces between them, summed up in a window.

Defined cases: a NULL text is an empty one; empty texts have no finding; rows of
equal text share a blob, rows of equal path and text stay as many rows; bytes that
are no UTF-8 count as U+FFFD in the places; an empty table gives an empty report;
further columns are carried along, whatever their names, unless they are named like
a result column, which replaces them.  A third of all rows may hold one text: texts
are aggregated before their shuffle, and findings meet the paths by blob and salt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, shared_path, stored


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has at least
    ``least`` code points; a text without ``anchor`` is not searched."""
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    anchor: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order of their kinds in a report.  ``hex`` and ``access`` have their least
#: length in the pattern, which finds the same as dropping shorter matches: a shorter
#: run holds no longer one.
RULES = (
    Rule("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
         r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", anchor="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----", anchor="-----BEGIN "),
    Rule("github", 1, r"gh[oprsu]_[A-Za-z0-9]{36,}", anchor="gh"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", anchor="xox"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", anchor="eyJ"),
    Rule("urlauth", 1, r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@", anchor="://"),
)

SALTS = 32
_SCANS = "blob string, rules array<string>, batch string"
_FINDINGS = "blob string, rule string, start bigint, end bigint, batch string"


def _hits(found: Column, pieces: Column, held: Column, rule: Rule) -> Column:
    """The matches of one text: their number, the gap before each, their length."""
    return F.transform(found, lambda m, i: F.struct(
        F.lit(rule.name).alias("rule"), i.alias("seq"), F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("len"),
        (F.length(F.get(held, i)) >= rule.least).alias("ok")))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, rules) -> (blob, rules, hits): each text is searched with the
    rules that its row names."""
    none = F.array().cast("array<string>")
    found = []
    for r in rules:
        due = F.array_contains("rules", r.name)
        if r.anchor:
            due = due & F.contains(F.col("text"), F.lit(r.anchor))
        found.append(F.when(due, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(none))
    n = range(len(rules))
    rows = blobs.select("blob", "text", "rules", *[c.alias(f"m{i}") for i, c in enumerate(found)])
    pieces = [F.when(F.size(f"m{i}") > 0, F.split("text", rules[i].pattern, -1)) for i in n]
    held = [F.when(F.size(f"m{i}") > 0, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)))
            if r.group else F.col(f"m{i}") for i, r in enumerate(rules)]
    rows = rows.select("*", *[c.alias(f"p{i}") for i, c in enumerate(pieces)], *[c.alias(f"g{i}") for i, c in enumerate(held)])
    hits = [_hits(F.col(f"m{i}"), F.col(f"p{i}"), F.col(f"g{i}"), rules[i]) for i in n]
    return rows.select("blob", "rules", F.concat(*hits).alias("hits"))


def places(scanned: DataFrame) -> DataFrame:
    """(blob, rule, start, end) of the hits that hold."""
    rows = scanned.select("blob", F.explode("hits").alias("h")).select("blob", "h.*")
    w = Window.partitionBy("blob", "rule").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(w))
    return rows.where("ok").select("blob", "rule", (F.col("end") - F.col("len")).alias("start"), "end")


class Ledger:
    """A ledger in a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        if len({r.kind for r in rules}) < len(rules):
            raise ValueError("one version of a rule at a time")
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules

    def _read(self, name: str, schema: str | None = None) -> DataFrame:
        try:
            reader = self.spark.read.schema(schema) if schema else self.spark.read
            return reader.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND" or not schema:
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, batch: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def add(self, docs: DataFrame, batch: str, path: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> None:
        body = F.coalesce(quoted(text).cast("string"), F.lit(""))
        blob = F.sha2(body.cast("binary"), 256)
        kept = docs.columns if keep is None else keep
        own = F.struct(*[quoted(c) for c in kept]) if kept else F.struct(F.lit(None).alias("none"))
        salt = F.pmod(F.xxhash64(quoted(path)), F.lit(SALTS)).cast("int")
        self._write(docs.select(own.alias("own"), blob.alias("blob"), F.octet_length(body).alias("bytes"), salt.alias("salt")),
                    "versions", batch)
        wanted = F.array(*[F.lit(r.name) for r in self.rules])
        blobs = docs.select(blob.alias("blob"), body.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        seen = self._read("scans", _SCANS).where(F.col("batch") != batch)
        seen = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("had"))
        due = blobs.join(seen, "blob", "left").select(
            "blob", "text", F.array_except(wanted, F.coalesce("had", F.array().cast("array<string>"))).alias("rules"))
        scanned = stored(scan_blobs(due.where(F.size("rules") > 0), self.rules), "scanned")
        self._write(places(scanned), "findings", batch)
        self._write(scanned.select("blob", "rules"), "scans", batch)

    def findings(self) -> DataFrame:
        """(blob, rule, start, end) of this ledger's rules, from complete batches."""
        done = self._read("scans", _SCANS).select("batch").distinct()
        rows = self._read("findings", _FINDINGS).where(F.col("rule").isin([r.name for r in self.rules]))
        return rows.join(done, "batch", "left_semi").drop("batch")

    def report(self, batch: str | None = None) -> DataFrame:
        """Every version (of one batch, or of all) with its blob, its bytes and its
        ``spans``, by start, then in the order of the rules."""
        versions = self._read("versions")
        if batch is not None:
            versions = versions.where(F.col("batch") == batch)
        order = F.create_map(*[F.lit(v) for i, r in enumerate(self.rules) for v in (r.name, i)])
        one = F.struct("start", order[F.col("rule")].alias("no"), F.element_at(F.split("rule", "@"), 1).alias("kind"), "end")
        spans = self.findings().groupBy("blob").agg(F.sort_array(F.collect_list(one)).alias("spans"))
        # a blob with findings goes once to each salt that its paths have
        spread = versions.select("blob", "salt").distinct().join(spans, "blob")
        rows = versions.join(spread, ["blob", "salt"], "left")
        kept = [c for c in versions.schema["own"].dataType.fieldNames() if c.lower() not in ("blob", "bytes", "spans")]
        got = F.transform(F.coalesce("spans", F.array()), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return rows.select(*[F.col("own").getField(c).alias(c) for c in kept], "blob", "bytes", got.alias("spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text",
         keep: list[str] | None = None) -> DataFrame:
    """The report of one batch in a new ledger."""
    spark = docs.sparkSession
    ledger = Ledger(spark, shared_path(spark, "ledger"), rules)
    ledger.add(docs, "0", path, text, keep)
    return ledger.report()


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
