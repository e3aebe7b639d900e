"""Result records: canonical JSON, digests, conformance."""

from __future__ import annotations

import hashlib
import json
import math
from bisect import insort
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.checks import require_none
from vintara.errors import ResultStructureError
from vintara.storage import saved, small

VERDICTS = ("consistent", "sanctioned_deviation", "reject")


def canonical_json(value) -> str:
    """Sorted, compact, ASCII JSON; numbers must be finite."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def strict_json(text: str):
    """Parse JSON without repeated keys or numbers that aren't finite."""

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ResultStructureError("a key is there twice")
        return dict(items)

    def constant(name):
        raise ResultStructureError(f"not a finite number: {name}")

    try:
        return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    except json.JSONDecodeError as bad:
        raise ResultStructureError(str(bad)) from bad


def freeze(value):
    """A setting as a canonical value: nested maps and sequences of finite scalars."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float) and math.isfinite(value):
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return [freeze(v) for v in value]
    if isinstance(value, Mapping) and all(isinstance(k, str) for k in value):
        return {k: freeze(v) for k, v in sorted(value.items())}
    raise ResultStructureError(f"not a setting: {value!r}")


#: Periods of one bucket of a path's digest.
DIGEST_PERIODS = 10_000


def path_digests(ledger: DataFrame, by: str = "strategy_id") -> DataFrame:
    """``by, n_periods, digest`` of each path, over its rows in order.

    A row is canonical JSON of its columns; the rows of ``DIGEST_PERIODS`` periods are digested in their order,
    and a path's digest is that of its buckets' numbers and digests in theirs. No path is held by one task.
    """
    columns = sorted(ledger.columns)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[pa.RecordBatch] = []
        n, hashed = 0, hashlib.sha256()
        for batch in batches:
            names = names or [batch]
            for row in batch.select(columns).to_pylist():
                as_json = {k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in row.items()}
                hashed.update(canonical_json(as_json).encode() + b"\n")
            n += batch.num_rows
        key = [names[0].column(c)[:1] for c in (by, "_bucket")]
        yield pa.RecordBatch.from_arrays([*key, pa.array([n]), pa.array([hashed.hexdigest()])], names=[by, "_bucket", "n", "d"])

    rows = ledger.withColumn("_bucket", F.floor(F.col("period") / DIGEST_PERIODS).cast("long"))
    ordered = rows.repartition(by, "_bucket").sortWithinPartitions(by, "_bucket", "period")
    buckets = ordered.groupBy(by, "_bucket").applyInArrow(digest, f"`{by}` {dict(ledger.dtypes)[by]}, _bucket long, n long, d string")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "n", "d"))), lambda x: F.concat_ws(":", x["_bucket"], x["n"], x["d"]))
    return buckets.groupBy(by).agg(F.sum("n").alias("n_periods"), F.sha2(F.array_join(listed, ","), 256).alias("digest"))


def ledger_digest(ledger: DataFrame, strategy_id: str) -> str | None:
    """The digest of one strategy's path (:func:`path_digests`); none if it has no rows."""
    found = path_digests(ledger.where(F.col("strategy_id") == strategy_id)).first()
    return found and found["digest"]


# Records as rows.


def run_records(ledger: DataFrame, measured: DataFrame, manifest: RunManifest, conformance: DataFrame, declared: Mapping[str, object]) -> DataFrame:
    """``strategy_id, record``: for each path of a run a record of all that is to be kept of it, as a VARIANT.

    It holds the run's ``manifest``, the path's bounds and ``digest``, the ``metrics`` and the declaration that they hold
    under, and the ``conformance`` of settings (:func:`verdicts`). A run with a rejected setting has no records.
    """
    require_none(conformance.where("verdict = 'reject'"), ResultStructureError, "a setting that nobody sanctioned")
    settings = {r["field"]: {"declared": r["declared"], "effective": r["effective"], "verdict": r["verdict"]} for r in conformance.collect()}
    fixed = {"manifest": asdict(manifest), "conformance": settings, "declared": freeze(dict(declared))}
    names = [c for c in measured.columns if c not in ("strategy_id", "n_periods")]
    path = F.struct("n_periods", *(F.col(c).cast("string").alias(c) for c in ("period_start", "period_end")), "wealth_open", "wealth_close", "digest")
    rows = path_results(ledger).join(path_digests(ledger).drop("n_periods"), "strategy_id").join(measured.drop("n_periods"), "strategy_id")
    parts = F.struct("strategy_id", path.alias("path"), F.struct(*names).alias("metrics"))
    both = F.concat(F.lit(canonical_json(fixed)[:-1] + ","), F.substring(F.to_json(parts, {"ignoreNullFields": "false"}), 2, 2**31 - 1))
    return rows.select("strategy_id", F.parse_json(both).alias("record"))


def records_to_json(records: DataFrame) -> DataFrame:
    """``strategy_id, text``: each record as canonical JSON, its keys in order."""
    return records.select("strategy_id", F.to_json("record").alias("text"))


#: What a record must have, and of which type.
RECORD_FIELDS = {
    "$.strategy_id": "string", "$.manifest.experiment_id": "string", "$.manifest.data_sha256": "string", "$.path.n_periods": "bigint",
    "$.path.digest": "string", "$.path.wealth_close": "double", "$.metrics.metric_status": "string",
}


def records_from_json(texts: DataFrame) -> DataFrame:
    """``strategy_id, record`` of ``strategy_id, text``; strict.

    Text that isn't JSON or has a key twice, a missing field, one of another type, and another strategy than stated are
    :class:`ResultStructureError`, for all rows at once.
    """
    parsed = saved(texts.select("strategy_id", "text", F.try_parse_json("text").alias("record")))
    fields = [F.try_variant_get("record", path, kind).isNull() for path, kind in RECORD_FIELDS.items()]
    wrong = F.col("record").isNull() | ~F.try_variant_get("record", "$.strategy_id", "string").eqNullSafe(F.col("strategy_id"))
    for test in fields:
        wrong = wrong | test
    require_none(parsed.where(wrong).select("strategy_id", F.left("text", F.lit(100)).alias("text")), ResultStructureError, "not a record")
    return parsed.select("strategy_id", "record")


#: Leading hex digits of an identity's hash by which digests are taken, level by level.
MEMBER_LEVELS = (6, 3, 0)


def _joined(digests) -> str:
    return hashlib.sha256(",".join(digests).encode()).hexdigest()


def _digests_over_time(members: Sequence[tuple[str, int, int]], digits: int) -> Iterator[tuple[int, int, str]]:
    """``place, n, digest`` of each place at which any member is there; ``members`` has hashes, first and end places.

    The digest is over those of the groups with the same leading ``digits``. It changes only where a member comes or goes, and then
    only in the member's group: no list is made again for a place at which it is as before.
    """
    starts = sorted({h[:digits] for h, _, _ in members})
    slot = {start: i for i, start in enumerate(starts)}
    events: dict[int, list] = {}
    for h, first, end in members:
        events.setdefault(first, []).append((h, True))
        events.setdefault(end, []).append((h, False))
    groups: list[list[str]] = [[] for _ in starts]
    digests: list[str | None] = [None] * len(starts)
    places, n = sorted(events), 0
    for place, until in zip(places, places[1:]):
        touched = set()
        for h, comes in events[place]:
            at = slot[h[:digits]]
            insort(groups[at], h) if comes else groups[at].remove(h)
            n += 1 if comes else -1
            touched.add(at)
        for at in touched:
            digests[at] = _joined(groups[at]) if groups[at] else None
        if n:
            digest = _joined(d for d in digests if d)
            for p in range(place, until):
                yield p, n, digest


def membership_digests(vintages: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decision_time, n_members, digest`` of the identities that each decision admits.

    The frames are those of :func:`pit.valid_vintages`: each identity once with the decisions that admit it, and
    their places. The hashes of identities are sorted and digested within each group of equal leading digits,
    then the groups' digests, in their order, within each shorter one: so a list
    has about 4096 entries, or one of 16.8 million of the identities if that is more.

    Identities are dealt once, by the shorter digits, and each of these groups is digested for all decisions in turn.
    """
    longer, shorter, _ = MEMBER_LEVELS

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[tuple[str, int, int]] = []
        for batch in batches:
            members += zip((h.hex() for h in batch.column("h").to_pylist()), *(batch.column(c).to_pylist() for c in ("first_place", "end_place")))
        found = _digests_over_time(members, longer)
        while some := list(islice(found, 10_000)):
            at = pa.array([members[0][0][:shorter]] * len(some))
            yield pa.RecordBatch.from_arrays([at, *(pa.array(c) for c in zip(*some))], names=["at", "place", "n", "d"])

    # Microseconds since 1970: the same identity in every session's time zone.
    times = (F.unix_micros(F.col(c).cast("timestamp")).cast("string") for c in ("observation_time", "available_time"))
    hashed = vintages.select(F.sha2(F.to_json(F.array("series_id", *times)), 256).alias("_hex"), "first_place", "end_place")
    hashed = hashed.select(F.substring("_hex", 1, shorter).alias("at"), F.unhex("_hex").alias("h"), "first_place", "end_place")
    level = hashed.groupBy("at").applyInArrow(digest, "at string, place long, n long, d string")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"])
    whole = level.groupBy("place").agg(F.sum("n").alias("n_members"), F.sha2(F.array_join(ordered, ","), 256).alias("digest"))
    return whole.join(small(decisions), "place").select("decision_time", "n_members", "digest")


def verdicts(spark: SparkSession, declared: Mapping[str, str], effective: Mapping[str, str], sanctioned: set[str]) -> DataFrame:
    """``field, declared, effective, verdict`` of each setting."""
    a = spark.createDataFrame(list(declared.items()), "field string, declared string")
    b = spark.createDataFrame(list(effective.items()), "field string, effective string")
    both = a.join(b, "field", "full")
    verdict = (
        F.when(F.col("declared").eqNullSafe(F.col("effective")), "consistent")
        .when(F.col("field").isin(*sanctioned), "sanctioned_deviation")
        .otherwise("reject")
    )
    return both.select("field", "declared", "effective", verdict.alias("verdict"))


@dataclass(frozen=True)
class SanctionedDeviation:
    """A setting that may differ from its declaration, and on whose authority."""

    field: str
    authority: str
    reference: str
    reason: str
    approved_at: str


@dataclass(frozen=True)
class RunManifest:
    """What identifies a run."""

    experiment_id: str
    data_sha256: str
    code_version: str
    seed: int
    started_at: str
    environment: str

    def to_json(self) -> str:
        return canonical_json(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> RunManifest:
        data = strict_json(text)
        if set(data) != set(cls.__dataclass_fields__):
            raise ResultStructureError("not a manifest")
        return cls(**data)


@dataclass(frozen=True)
class MetricsBlock:
    """Six measures and the declaration they hold under."""

    measures: Mapping[str, float | None]
    basis: str
    periods_per_year: int
    gamma: float
    risk_free: float


@dataclass(frozen=True)
class PathResult:
    """A wealth path: its digest, bounds and measures."""

    digest: str
    n_periods: int
    period_start: str
    period_end: str
    wealth_open: float
    wealth_close: float
    metrics: Sequence[MetricsBlock] = ()


@dataclass(frozen=True)
class ResultRecord:
    """What a strategy's run left: manifest, settings as declared and used, paths."""

    manifest: RunManifest
    strategy_id: str
    declared: Mapping[str, object]
    effective: Mapping[str, object]
    paths: Sequence[PathResult] = ()
    deviations: Sequence[SanctionedDeviation] = ()
    relations: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        allowed = {d.field for d in self.deviations}
        for name in set(self.declared) | set(self.effective):
            if freeze(self.declared.get(name)) != freeze(self.effective.get(name)) and name not in allowed:
                raise ResultStructureError(f"{name} isn't as declared")

    @property
    def verdict(self) -> str:
        same = freeze(dict(self.declared)) == freeze(dict(self.effective))
        return "consistent" if same else "sanctioned_deviation"

    def to_json(self) -> str:
        return canonical_json(freeze(asdict(self)))

    @classmethod
    def from_json(cls, text: str) -> ResultRecord:
        data = strict_json(text)
        if set(data) != set(cls.__dataclass_fields__):
            raise ResultStructureError("not a result record")
        paths = [
            PathResult(**(p | {"metrics": [MetricsBlock(**m) for m in p["metrics"]]})) for p in data.pop("paths")
        ]
        return cls(
            manifest=RunManifest(**data.pop("manifest")),
            deviations=[SanctionedDeviation(**d) for d in data.pop("deviations")],
            paths=paths,
            **data,
        )


def path_results(ledger: DataFrame) -> DataFrame:
    """``strategy_id, n_periods`` and the bounds of each path in time and wealth."""
    return ledger.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.min("period_start").alias("period_start"),
        F.max("period_end").alias("period_end"),
        F.min_by("wealth_open", "period").alias("wealth_open"),
        F.max_by("wealth_close", "period").alias("wealth_close"),
    )
