"""Scan again after a change of policy: only what the change makes necessary.

A stored row says with which detectors it was scanned, each by name and fingerprint.
Findings of detectors that a new policy has unchanged are kept, those of detectors it
lacks are dropped, and texts are read only for the detectors that are new or different.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.detect import detections
from inkveil.functions.detectors import Detector, selected
from inkveil.operators.scan import policy_detections
from inkveil.plans.policy import ScanPolicy

#: columns of a stored row beside its keys
STORED = ("version", "detections", "scanned_with")


def fingerprint(detector: Detector) -> str:
    """Name and digest of all that decides on a detector's findings.

    Screens and literals only pass over texts without a finding: they have no part in it.
    """
    d = detector
    rules = (d.pattern, d.group, d.check, d.finder, d.within, d.category, d.severity, d.message)
    return f"{d.name}:{hashlib.sha256(repr(rules).encode()).hexdigest()[:16]}"


def chosen(policy: ScanPolicy) -> list[tuple[int, Detector]]:
    return selected(policy.detectors, policy.min_severity)


def fingerprints(policy: ScanPolicy) -> list[str]:
    """Of all detectors that a policy runs, in order."""
    return [fingerprint(d) for _, d in chosen(policy)]


def _texts(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.expr("cast(array() AS array<string>)")


def scanned(
    documents: DataFrame,
    keys: Sequence[str],
    version: Column,
    text: str = "text",
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Keys and what is stored of a scan: version, findings without values, fingerprints."""
    policy = policy or ScanPolicy.documents()
    found = policy_detections(text, policy)
    return documents.select(
        *keys,
        version.alias("version"),
        F.transform(found, lambda d: d.dropFields("value")).alias("detections"),
        _texts(fingerprints(policy)).alias("scanned_with"),
    )


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    same = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]
    return reduce(lambda a, b: a & b, same)


def _merged(kept: Column, fresh: Column, policy: ScanPolicy) -> Column:
    """Findings in order of position, then of the policy's detectors."""
    place = F.create_map(*[F.lit(x) for n, d in chosen(policy) for x in (d.name, n)])
    both = F.transform(
        F.concat(kept, fresh),
        lambda d: F.struct(
            d["start"].alias("start"),
            F.element_at(place, d["type"]).alias("place"),
            d.withField("ordinal", F.element_at(place, d["type"])).alias("found"),
        ),
    )
    return F.transform(F.sort_array(both), lambda x: x["found"])


def rescanned(
    stored: DataFrame,
    documents: DataFrame,
    keys: Sequence[str],
    version: Column,
    text: str = "text",
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Stored rows under a new policy.

    ``documents`` have the keys, the version and the text of the stored rows; rows whose
    version is not there any more are left out (:func:`unscanned` finds new ones).  Which
    detectors have changed is settled while the plan is built, from the different lists of
    fingerprints in ``stored``, as many as policies have been in use.  Where none has
    changed, texts aren't read at all.  Only findings are joined, never texts.
    """
    policy = policy or ScanPolicy.documents()
    wanted = fingerprints(policy)
    detector_of = dict(zip(wanted, [d for _, d in chosen(policy)]))
    branches: dict[tuple[str, ...], list[list[str]]] = {}
    for row in stored.select("scanned_with").distinct().collect():
        missing = tuple(x for x in wanted if x not in row["scanned_with"])
        branches.setdefault(missing, []).append(list(row["scanned_with"]))
    names = [x.split(":")[0] for x in wanted]
    parts = []
    for missing, lists in branches.items():
        rows = stored.where(F.col("scanned_with").isin(*[_texts(x) for x in lists]))
        unchanged = [n for n, x in zip(names, wanted) if x not in missing]
        kept = F.filter("s.detections", lambda d: d["type"].isin(*unchanged))
        present = documents.select(*keys, version.alias("version"))
        fresh = F.expr("cast(array() AS array<string>)")
        if missing:
            run = [detector_of[x] for x in missing]
            some = [d.name if (d.name, d) in _built_in() else d for d in run]
            found = F.transform(detections(text, some), lambda d: d.dropFields("value"))
            present = documents.select(*keys, version.alias("version"), found.alias("fresh"))
            fresh = F.col("d.fresh")
        met = rows.alias("s").join(present.alias("d"), _same("s", "d", [*keys, "version"]))
        merged = _merged(kept, fresh, policy) if missing else _reordered(kept, policy)
        parts.append(
            met.select(
                *[F.col(f"s.{key}").alias(key) for key in keys],
                F.col("s.version").alias("version"),
                merged.alias("detections"),
                _texts(wanted).alias("scanned_with"),
            )
        )
    if not parts:
        return stored.select(*keys, *STORED).limit(0)
    return reduce(DataFrame.unionByName, parts)


def _built_in() -> set[tuple[str, Detector]]:
    return {(d.name, d) for _, d in selected(None)}


def _reordered(kept: Column, policy: ScanPolicy) -> Column:
    if not chosen(policy):
        return kept
    return _merged(kept, F.filter(kept, lambda d: F.lit(False)), policy)


def unscanned(
    stored: DataFrame, documents: DataFrame, keys: Sequence[str], version: Column
) -> DataFrame:
    """Documents of which ``stored`` has no row of the same version."""
    have = stored.select(*keys, "version")
    asked = documents.select(*keys, version.alias("version"))
    met = asked.alias("d").join(have.alias("s"), _same("d", "s", [*keys, "version"]), "left_anti")
    # keys alone decide; texts are looked up for what is new
    new = met.select(*[f"d.{key}" for key in keys], "d.version")
    texts = documents.withColumn("_version", version)
    same = [F.col(f"t.{key}").eqNullSafe(F.col(f"n.{key}")) for key in keys]
    same.append(F.col("t._version").eqNullSafe(F.col("n.version")))
    return texts.alias("t").join(new.alias("n"), reduce(lambda a, b: a & b, same), "left_semi").select(
        *[F.col(f"t.{c}").alias(c) for c in documents.columns]
    )
