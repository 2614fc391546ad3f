"""A project: a folder of resources with a manifest of what made each of them.

Resources have a type: csv, parquet and feature_vectors are DataFrames, model is a Spark ML model, json, txt, png and
joblib (kept as pickled bytes) are single objects. Names get a random suffix. The manifest is one JSON file, replaced
atomically; paths are those of a mounted file system.
"""

from __future__ import annotations

import functools
import inspect
import json
import os
import pickle
import shutil
import uuid
from collections.abc import Callable
from datetime import datetime
from pathlib import Path
from typing import Any

import pyspark
from pyspark.sql import DataFrame, SparkSession

from ..operators.relational import nan_to_null

FRAMES = {"csv", "parquet", "feature_vectors"}
TYPES = {"csv": ".csv", "parquet": ".parquet", "feature_vectors": ".parquet", "model": ".model", "json": ".json", "txt": ".txt", "png": ".png", "joblib": ".pkl"}
FIELDS = ("filename", "type_tag", "explanation", "timestamp", "parent_function_name", "parent_function_inputs", "module_name")


def supported_types() -> list[str]:
    return list(TYPES)


def check_data_dir(folder: str | Path) -> dict[str, Any]:
    """What is known of a folder for projects: whether it is there, is a folder, can be written to, and the names of the
    projects in it."""
    path = Path(folder)
    there = path.is_dir()
    names = sorted(p.name.removesuffix("_manifest.json") for p in path.glob("*/*_manifest.json")) if there else []
    return {"folder": str(path), "exists": path.exists(), "is_folder": there, "writable": there and os.access(path, os.W_OK), "projects": names}


class Project:
    """A catalog of the resources in one folder."""

    def __init__(self, spark: SparkSession, folder: str | Path, name: str) -> None:
        self.spark, self.folder, self.name = spark, Path(folder), name
        self.manifest = self.folder / f"{name}_manifest.json"

    @classmethod
    def create(cls, spark: SparkSession, folder: str | Path, name: str) -> Project:
        project = cls(spark, folder, name)
        if project.manifest.exists():
            raise FileExistsError(project.manifest)
        project.folder.mkdir(parents=True, exist_ok=True)
        project._write({"project": name, "created": project._now(), "versions": {"spark": spark.version, "pyspark": pyspark.__version__}, "resources": []})
        return project

    @staticmethod
    def _now() -> str:
        return datetime.now().strftime("%Y-%m-%d %H:%M:%S.%f")

    def read(self) -> dict[str, Any]:
        if not self.manifest.exists():
            raise FileNotFoundError(self.manifest)
        return json.loads(self.manifest.read_text(encoding="utf-8"))

    def _write(self, data: dict[str, Any]) -> None:
        part = self.manifest.with_suffix(f".{uuid.uuid4().hex}.part")
        part.write_text(json.dumps(data, indent=2, ensure_ascii=False), encoding="utf-8")
        os.replace(part, self.manifest)

    def resources(self) -> list[dict[str, Any]]:
        return self.read()["resources"]

    def add(self, filename: str, type_tag: str, explanation: str = "", function: str = "unknown", inputs: dict[str, str] | str = "unknown", module: str = "unknown") -> None:
        data = self.read()
        data["resources"].append(dict(zip(FIELDS, (filename, type_tag, explanation, self._now(), function, inputs, module), strict=True)))
        self._write(data)

    def store(self, obj: Any, name: str, type_tag: str, explanation: str = "", lineage: dict[str, Any] | None = None) -> str:
        """Write an object and enter it in the manifest; the name it got."""
        if type_tag not in TYPES:
            raise ValueError(f"unknown type {type_tag!r}; there are {list(TYPES)}")
        filename = f"{name}_{uuid.uuid4().hex[:8].upper()}{TYPES[type_tag]}"
        path = str(self.folder / filename)
        if type_tag == "csv":
            obj.write.option("header", True).csv(path)
        elif type_tag in FRAMES:
            obj.write.parquet(path)
        elif type_tag == "model":
            if hasattr(obj, "write"):
                obj.write().save(path)
            else:  # a bundle of operators.ml
                from ..operators import ml

                ml.save(obj, self.spark, path)
        elif type_tag == "json":
            Path(path).write_text(json.dumps(obj, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
        elif type_tag == "txt":
            Path(path).write_text(obj, encoding="utf-8")
        else:
            Path(path).write_bytes(obj if type_tag == "png" else pickle.dumps(obj))
        lineage = lineage or {}
        self.add(filename, type_tag, explanation, lineage.get("function", "unknown"), lineage.get("inputs", "unknown"), lineage.get("module", "unknown"))
        return filename

    def load(self, filename: str) -> Any:
        entry = next((r for r in self.resources() if r["filename"] == filename), None)
        if entry is None:
            raise ValueError(f"{filename} is not in the manifest")
        path = self.folder / filename
        if not path.exists():
            raise FileNotFoundError(path)
        kind = entry["type_tag"]
        if kind == "csv":
            return nan_to_null(self.spark.read.option("header", True).option("inferSchema", True).option("nanValue", "NaN").csv(str(path)))
        if kind in FRAMES:
            return self.spark.read.parquet(str(path))
        if kind == "model":
            if (path / "bundle").exists():
                from ..operators import ml

                return ml.load(self.spark, str(path))
            from pyspark.ml import PipelineModel

            return PipelineModel.load(str(path))
        if kind == "json":
            return json.loads(path.read_text(encoding="utf-8"))
        if kind == "txt":
            return path.read_text(encoding="utf-8")
        return path.read_bytes() if kind == "png" else pickle.loads(path.read_bytes())

    def remove(self, filename: str, delete: bool = False) -> None:
        data = self.read()
        kept = [r for r in data["resources"] if r["filename"] != filename]
        if len(kept) == len(data["resources"]):
            raise ValueError(f"{filename} is not in the manifest")
        self._write(data | {"resources": kept})
        path = self.folder / filename
        if delete and path.exists():
            shutil.rmtree(path) if path.is_dir() else path.unlink()

    def untracked(self) -> list[str]:
        known = {r["filename"] for r in self.resources()}
        return sorted(p.name for p in self.folder.iterdir() if p.name not in known and p != self.manifest and not p.name.startswith("."))

    # Sources

    def import_csv(self, path: str, name: str) -> str:
        df = nan_to_null(self.spark.read.option("header", True).option("inferSchema", True).csv(path))
        return self.store(df, name, "csv", f"imported from {path}")

    def import_csv_text(self, text: str, name: str) -> str:
        """CSV held in a string; a few megabytes at most, as it passes the driver."""
        import io

        import pandas as pd

        return self.store(self._small(pd.read_csv(io.StringIO(text))), name, "csv", "imported from text")

    def import_excel(self, path: str, name: str, sheet: str | int = 0) -> str:
        """One sheet, where a reader of the format is installed."""
        import pandas as pd

        return self.store(self._small(pd.read_excel(path, sheet_name=sheet)), name, "csv", f"imported from {path}")

    def _small(self, pdf) -> DataFrame:
        return nan_to_null(self.spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).infer_objects()))


def summarise_projects(folder: str | Path) -> list[dict[str, Any]]:
    """Name, creation time and resources by type of every project in a folder."""
    out = []
    for path in sorted(Path(folder).glob("*_manifest.json")):
        data = json.loads(path.read_text(encoding="utf-8"))
        kinds: dict[str, int] = {}
        for r in data["resources"]:
            kinds[r["type_tag"]] = kinds.get(r["type_tag"], 0) + 1
        out.append({"project": data["project"], "created": data["created"], "resources": kinds})
    return out


def recorded(type_tag: str = "parquet") -> Callable:
    """Decorator: an operator on DataFrames that also takes project and name, and stores its result with its own name,
    plain arguments and first line of documentation."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args: Any, project: Project | None = None, name: str | None = None, **kwargs: Any) -> Any:
            out = f(*args, **kwargs)
            if project is not None:
                bound = inspect.signature(f).bind(*args, **kwargs).arguments
                inputs = {k: repr(v) for k, v in bound.items() if not isinstance(v, DataFrame)}
                project.store(out, name or f.__name__, type_tag, (inspect.getdoc(f) or "").split("\n")[0], {"function": f.__name__, "inputs": inputs, "module": f.__module__})
            return out

        return run

    return wrap
