"""Model bundle: forest + scaler + label dictionary + feature contract + metrics.

A version is an immutable folder and a manifest.  The folder is written first;
the manifest, named by the version's number, is then created only if that
number is still free, and nothing is ever overwritten or deleted.  A reader
takes the newest manifest that is whole and whose folder is there, so a save
that dies on the way leaves the version before it current.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from flowlens.operators import forest
from flowlens.operators.forest import Forest
from flowlens.session import create_if_absent, file_system


@dataclass
class Bundle:
    model: Forest
    contract: list[str]
    classes: list[str]
    scaler: dict[str, tuple[float, float]]
    label: str
    benign: str
    metrics: dict[str, float] = field(default_factory=dict)


def _manifests(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all manifests, whole or not, newest first."""
    fs, p = file_system(spark, os.path.join(root, "manifests"))
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted((int(m.group(1)) for m in (re.fullmatch(r"(\d{8})\.json", n) for n in names) if m), reverse=True)


def _manifest_path(root: str, version: int) -> str:
    return os.path.join(root, "manifests", f"{version:08d}.json")


def _manifest(spark: SparkSession, root: str, version: int) -> dict | None:
    """A manifest's content, or None if it or its folder is not whole."""
    text = "\n".join(r["value"] for r in spark.read.text(_manifest_path(root, version)).collect())
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        return None
    fs, p = file_system(spark, os.path.join(root, found["folder"], "model", "metadata"))
    return found if fs.exists(p) else None


def current_version(spark: SparkSession, root: str) -> int | None:
    """The newest version that is whole; None if there is none."""
    return next((v for v in _manifests(spark, root) if _manifest(spark, root, v)), None)


def stage_bundle(spark: SparkSession, root: str, bundle: Bundle) -> str:
    """Write the version's folder; nothing refers to it yet."""
    folder = f"v-{uuid.uuid4().hex[:12]}"
    bundle.model.save(os.path.join(root, folder, "model"))
    return folder


def commit_bundle(spark: SparkSession, root: str, folder: str, bundle: Bundle) -> int:
    """Give a staged folder the next free number; writers that race get different ones."""
    text = json.dumps({"folder": folder, "contract": bundle.contract, "classes": bundle.classes,
                       "scaler": {k: list(v) for k, v in bundle.scaler.items()},
                       "label": bundle.label, "benign": bundle.benign, "metrics": bundle.metrics})
    version = max(_manifests(spark, root), default=0) + 1
    while not create_if_absent(spark, _manifest_path(root, version), text):
        version += 1
    return version


def save_bundle(spark: SparkSession, root: str, bundle: Bundle) -> int:
    return commit_bundle(spark, root, stage_bundle(spark, root, bundle), bundle)


def stored_metrics(spark: SparkSession, root: str) -> dict | None:
    """Metrics of the current version; None if there is none."""
    version = current_version(spark, root)
    return None if version is None else _manifest(spark, root, version)["metrics"]


def load_bundle(spark: SparkSession, root: str, version: int | None = None) -> Bundle:
    """The given version, by default the current one; raises if it is missing or not whole."""
    version = current_version(spark, root) if version is None else version
    found = _manifest(spark, root, version) if version is not None and version in _manifests(spark, root) else None
    if found is None:
        raise ValueError(f"no whole model version {'' if version is None else version} under {root}")
    return Bundle(model=forest.load(spark, os.path.join(root, found["folder"], "model")),
                  contract=found["contract"], classes=found["classes"],
                  scaler={k: tuple(v) for k, v in found["scaler"].items()}, label=found["label"],
                  benign=found["benign"], metrics=found["metrics"])


def class_dictionary(spark: SparkSession, bundle: Bundle) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(bundle.classes)],
                                 "label string, label_idx int")
