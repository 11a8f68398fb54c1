"""Seals over evidence, structural checks, credential scans and redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import join_null_safe
from ..operators.population import LEAF, set_digest
from ..session import settle
from .schemas import CORRUPT

# Fields every trace record must have, and credential shapes.
REQUIRED_TRACE_FIELDS = ("task_id", "condition_id", "condition", "trial_id", "termination", "trace")
SECRET_PATTERN = r"hf_[A-Za-z0-9]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|-----BEGIN .*PRIVATE KEY-----"
HOME_PATTERN = r"/Users/[^/\s\"']+"
HOME_REPLACEMENT = "/REDACTED_HOME"


def file_digests(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(run_id, name, actual): sha256 of whole files, the run being the parent folder."""
    files = spark.read.format("binaryFile").load(paths)
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -2).alias("run_id"), F.element_at(parts, -1).alias("name"), F.sha2("content", 256).alias("actual")
    )


def seal_entries(seals: DataFrame, run: str = "run_id", files: str = "files") -> DataFrame:
    """(run_id, name, expected) of the seals' name -> sha256 maps."""
    return seals.select(run, F.explode(files).alias("name", "expected"))


def file_integrity(sealed: DataFrame, actual: DataFrame, run: str = "run_id", name: str = "name") -> DataFrame:
    """Status of every unit that is sealed or present: ok, mismatch, undeclared or missing.

    A unit in neither place is no error and yields no row.
    """
    both = sealed.select(run, name, F.col("expected"), F.lit(None).cast("string").alias("actual")).unionByName(
        actual.select(run, name, F.lit(None).cast("string").alias("expected"), F.col("actual"))
    )
    merged = both.groupBy(run, name).agg(F.max("expected").alias("expected"), F.max("actual").alias("actual"))
    status = (
        F.when(F.col("expected").isNull(), "undeclared").when(F.col("actual").isNull(), "missing")
        .when(F.col("expected") == F.col("actual"), "ok").otherwise("mismatch")
    )
    return merged.withColumn("status", status)


def seal_table(units: DataFrame, manifests: DataFrame | None = None, run: str = "run_id", name: str = "name", digest: str = "actual",
               leaf: int = LEAF) -> DataFrame:
    """Seal row per run: number of units, the root of the digest tree over its ``name:sha256`` entries, the digest of its manifest
    (``manifests``: run, ``manifest_sha256``), and the seal's own digest over them.

    The entries are the units themselves: what a run had when it was sealed is kept as a table beside its seal.
    """
    counts = units.groupBy(run).agg(F.count(F.lit(1)).alias("n_units"))
    sealed = join_null_safe(counts, set_digest(units, [run], F.concat_ws(":", name, digest), "entries_sha256", leaf), [run])
    if manifests is None:
        sealed = sealed.withColumn("manifest_sha256", F.lit(None).cast("string"))
    else:
        sealed = join_null_safe(sealed, manifests.select(run, "manifest_sha256"), [run], "left")
    return sealed.withColumn("seal_sha256", seal_digest(run))


def seal_digest(run: str) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (run, "n_units", "entries_sha256", "manifest_sha256")]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def verify_runs(seals: DataFrame, sealed: DataFrame, actual: DataFrame, manifests: DataFrame, run: str = "run_id", name: str = "name",
                leaf: int = LEAF) -> DataFrame:
    """Verdict per run that is sealed or present, from seals, sealed entries (``expected``), units (``actual``) and manifests.

    ``seal`` is ``missing`` without a seal, ``corrupt`` when a field is absent or its own digest does not fit, ``mismatching`` when
    the sealed entries are not those it was made over, else ``ok``.  A run passes with an intact seal, the sealed manifest
    and every unit as sealed.
    """
    found = file_integrity(sealed, actual, run, name).groupBy(run).agg(*[
        F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "mismatch", "undeclared", "missing")])
    # the fields of a seal, what its entries give now, and the manifest: one row per run and source, met in an aggregate
    kinds = {"n_units": "bigint", "entries_sha256": "string", "manifest_sha256": "string", "seal_sha256": "string", "__fits": "boolean",
             "__entries": "string", "__manifest": "string", **{f"n_{s}": "bigint" for s in ("ok", "mismatch", "undeclared", "missing")}}

    def part(df: DataFrame, **columns: Column) -> DataFrame:
        return df.select(run, *[columns.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    fields = {c: F.col(c) for c in ("n_units", "entries_sha256", "manifest_sha256", "seal_sha256")}
    roots = set_digest(sealed, [run], F.concat_ws(":", name, "expected"), "root", leaf)
    rows = part(seals, **fields, __fits=F.coalesce(seal_digest(run) == F.col("seal_sha256"), F.lit(False)))
    rows = rows.unionByName(part(roots, __entries=F.col("root"))).unionByName(part(manifests, __manifest=F.col("manifest_sha256")))
    rows = rows.unionByName(part(found, **{c: F.col(c) for c in kinds if c.startswith("n_") and c != "n_units"}))
    merged = rows.groupBy(run).agg(*[F.max(c).alias(c) for c in kinds])
    absent = F.col("entries_sha256").isNull() | F.col("seal_sha256").isNull() | ~F.col("__fits")
    state = (
        F.when(F.col("__fits").isNull(), "missing").when(absent, "corrupt")
        .when(~F.col("entries_sha256").eqNullSafe(F.col("__entries")), "mismatching").otherwise("ok")
    )
    manifest_ok = F.coalesce(F.col("manifest_sha256") == F.col("__manifest"), F.lit(False))
    counts = [F.coalesce(f"n_{s}", F.lit(0).cast("bigint")).alias(f"n_{s}") for s in ("ok", "mismatch", "undeclared", "missing")]
    out = merged.select(run, state.alias("seal"), manifest_ok.alias("manifest_ok"), *counts)
    return out.withColumn("passed", (F.col("seal") == "ok") & F.col("manifest_ok") & (F.col("n_mismatch") + F.col("n_undeclared") + F.col("n_missing") == 0))


# Identity fields of a record that must agree with its run's declaration.
IDENTITY_FIELDS = ("deployment_id", "source_artifact_id", "weight_variant_id")
#: Codes of structural faults.
UNREADABLE, FIELDS_ABSENT, UNKEYED = "unreadable", "fields_absent", "condition_absent"
DUPLICATE_ID, DUPLICATE_KEY = "id_repeated", "key_repeated"
UNDECLARED, NO_CONDITIONS = "condition_unknown", "conditions_undeclared"


def contradicts(field: str) -> str:
    return f"{field}_contradicted"


def structural_audit(traces: DataFrame, conditions: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, error, item, n): structural faults of scanned trace records.

    ``runs`` declares the identities of a run, ``conditions`` its condition ids;
    of a run that declares none, the manifest is reported instead of its records.
    One scan turns every record into the values its checks look at and counts
    them per run; a duplicate counts once per surplus record.  What remains
    after dropping unique ids is small and is checked against the declarations.
    """
    corrupt = F.col(CORRUPT).isNotNull()
    gone = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED_TRACE_FIELDS])), ",")
    rows = traces.select(
        "run_id", "trial_id", "task_id", "condition_id", *IDENTITY_FIELDS, F.col("condition.mode").alias("mode"),
        F.col("condition.seed").alias("seed"), F.col("condition.repeat").alias("repeat"), corrupt.alias("__bad"),
        gone.alias("__gone"),
    )
    good = ~F.col("__bad") & (F.col("__gone") == "")
    keyed = good & F.col("mode").isNotNull()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    key = F.concat_ws("/", text("task_id"), text("mode"), text("seed"), text("repeat"))

    def seen(when: Column, error: str, item: Column) -> Column:
        return F.when(when, F.struct(F.lit(error).alias("error"), item.alias("item")))

    looks = F.array_compact(F.array(
        seen(F.col("__bad"), UNREADABLE, F.lit("")),
        seen(~F.col("__bad") & (F.col("__gone") != ""), FIELDS_ABSENT, F.col("__gone")),
        seen(good, DUPLICATE_ID, F.col("trial_id")),
        seen(good & F.col("mode").isNull(), UNKEYED, F.lit("")),
        seen(keyed, DUPLICATE_KEY, key),
        seen(keyed, UNDECLARED, F.col("condition_id")),
        *[seen(keyed & F.col(c).isNotNull(), contradicts(c), F.col(c)) for c in IDENTITY_FIELDS],
    ))
    counts = rows.select("run_id", F.inline(looks)).groupBy("run_id", "error", "item").agg(F.count(F.lit(1)).alias("n"))
    twice = F.col("error").isin(DUPLICATE_ID, DUPLICATE_KEY)
    counts = settle(counts.where(~twice | (F.col("n") > 1)).withColumn(
        "n", F.col("n") - F.when(twice, 1).otherwise(0)), "audit-counts")
    declared = conditions.select("run_id", F.lit(UNDECLARED).alias("error"), F.col("condition_id").alias("item"))
    identities = [F.struct(F.lit(contradicts(c)).alias("error"), F.col(c).alias("item")) for c in IDENTITY_FIELDS]
    wanted = runs.select("run_id", F.inline(F.array(*identities)))
    # an identity the run does not declare cannot be contradicted
    free = counts.join(wanted.where(F.col("item").isNull()).select("run_id", "error"), ["run_id", "error"], "left_anti")
    allowed = declared.unionByName(wanted.where(F.col("item").isNotNull())).distinct()
    silent = runs.select("run_id").distinct().join(conditions.select("run_id"), "run_id", "left_anti")
    free = free.join(silent.withColumn("error", F.lit(UNDECLARED)), ["run_id", "error"], "left_anti")
    found = free.join(allowed, ["run_id", "error", "item"], "left_anti").select("run_id", "error", "item", "n")
    return found.unionByName(silent.select("run_id", F.lit(NO_CONDITIONS).alias("error"), F.lit("").alias("item"), F.lit(1).cast("bigint").alias("n")))


def secret_scan(df: DataFrame, key: str, columns: Sequence[str], pattern: str = SECRET_PATTERN) -> DataFrame:
    """(key, location) of every text that looks like a credential."""
    hits = F.array_compact(F.array(*[F.when(F.rlike(F.col(c), F.lit(pattern)), F.lit(c)) for c in columns]))
    return df.select(F.col(key), F.explode(hits).alias("location"))


def require_no_secrets(df: DataFrame, key: str, columns: Sequence[str], pattern: str = SECRET_PATTERN) -> None:
    if not secret_scan(df, key, columns, pattern).isEmpty():
        raise ValueError("credential-like content found")


def redact(df: DataFrame, columns: Sequence[str], pattern: str = HOME_PATTERN, replacement: str = HOME_REPLACEMENT,
           protected: Sequence[str] = ()) -> DataFrame:
    """Replace ``pattern`` in ``columns``; the job fails if a protected column would change."""
    def clean(c: str) -> Column:
        return F.regexp_replace(F.col(c), pattern, replacement)

    def guarded(c: str) -> Column:
        refusal = F.raise_error(F.lit(f"redaction would alter protected content: {c}")).cast("string")
        return F.when(clean(c) != F.col(c), refusal).otherwise(F.col(c))

    return df.select(*[
        (clean(c) if c in columns and c not in protected else guarded(c) if c in protected else F.col(c)).alias(c)
        for c in df.columns
    ])


def redact_with_log(df: DataFrame, columns: Sequence[str], pattern: str = HOME_PATTERN, replacement: str = HOME_REPLACEMENT,
                    protected: Sequence[str] = ()) -> DataFrame:
    """Redacted rows with ``changes``, what ``redaction_log`` says of them: one scan, one replacement per column."""
    clean = df.select("*", *[F.regexp_replace(F.col(c), pattern, replacement).alias(f"__{c}") for c in columns])
    changes = F.array_compact(F.array(*[
        F.when(F.col(f"__{c}") != F.col(c), F.struct(
            F.lit(c).alias("location"), F.sha2(F.col(c), 256).alias("old_value_sha256"), F.lit(replacement).alias("replacement")))
        for c in columns
    ]))
    rest = redact(clean, [], pattern, replacement, protected)  # guards the protected columns
    return rest.select(*[(F.col(f"__{c}") if c in columns else F.col(c)).alias(c) for c in df.columns], changes.alias("changes"))


def redaction_log(df: DataFrame, key: str, columns: Sequence[str], pattern: str = HOME_PATTERN,
                  replacement: str = HOME_REPLACEMENT) -> DataFrame:
    """(key, location, old_value_sha256, replacement) of every text a redaction changes."""
    changes = F.array_compact(F.array(*[
        F.when(F.regexp_replace(F.col(c), pattern, replacement) != F.col(c),
               F.struct(F.lit(c).alias("location"), F.sha2(F.col(c), 256).alias("old_value_sha256")))
        for c in columns
    ]))
    return df.select(F.col(key), F.inline(changes)).withColumn("replacement", F.lit(replacement))
