"""A table of stored responses that grows by small batches without being rewritten.

Rows lie in parts by the first hex digits of a hash of their key: `data/v=<version>/part=<digits>`. A batch of new rows is
merged with the parts its keys fall in; only these are written, as a new version. `versions/<n>.json` says for every part
in which version it lies; it is written last and moved into place, so a reader sees all of a batch or nothing, and a batch
that failed leaves only folders that no version names. `vacuum` removes what no version names.

One writer at a time; any number of readers. The parts of a batch are at most 16^digits, and only their names come to the
driver. Keys are spread by their hash, so no part is hot; equal keys are thinned by an aggregate before they are shuffled.

Defined results: an unknown folder is an empty table; a batch without valid rows makes no version; rows without a key are
not stored; of equal keys the newest (with `newest`) or the stored, else the earliest one stays.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reuse import STORED, is_valid_response
from ..schemas import AUDIT
from ..session import stored
from ..skew import first_by, last_by
from .growing import _store


_SCHEMA = T.StructType([f for f in AUDIT.fields if f.name in STORED])


class ResponseStore:
    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits

    def _versions(self) -> list[str]:
        from pyarrow import fs

        store, path = _store(f"{self.path}/versions")
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(f.path for f in found if f.base_name.endswith(".json") and f.base_name[:1] != ".")

    def _state(self) -> dict:
        names = self._versions()
        if not names:
            return {"version": 0, "digits": self.digits, "parts": {}}
        store, _ = _store(self.path)
        with store.open_input_stream(names[-1]) as f:
            return json.loads(f.read())

    def _write_state(self, state: dict) -> None:
        store, path = _store(f"{self.path}/versions")
        store.create_dir(path, recursive=True)
        name, own = f"{path}/{state['version']:012d}.json", f"{path}/.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as f:
            f.write(json.dumps(state).encode())
        store.move(own, name)

    def _rows(self, parts: dict[str, int]) -> DataFrame:
        folders = [f"{self.path}/data/v={v}/part={p}" for p, v in sorted(parts.items())]
        return self.spark.read.schema(_SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], _SCHEMA)

    def read(self) -> DataFrame:
        """All rows of the newest version."""
        return self._rows(self._state()["parts"])

    def add(self, new: DataFrame, newest: bool = True) -> list[str]:
        """Stores the valid deterministic responses of a batch; gives the parts that were written.

        newest: a new row replaces a stored one of its key if it was made later; otherwise stored rows stay.
        """
        good = new.where(F.coalesce("deterministic", F.lit(True)) & F.col("cache_key").isNotNull() & (F.col("cache_key") != ""))
        good = good.where(is_valid_response(F.col("response"), F.col("request_type")))
        return self._merge(good.select(*STORED), newest)

    def replay(self, log: DataFrame) -> list[str]:
        """Adds the deterministic rows of an audit log whose keys are missing, the earliest of each."""
        keyed = F.coalesce("deterministic", F.lit(True)) & (F.coalesce("cache_key", F.lit("")) != "")
        return self._merge(log.where(keyed).select(*STORED), False)

    def _merge(self, rows: DataFrame, newest: bool) -> list[str]:
        state = self._state()
        part = F.substring(F.md5(F.col("cache_key").cast("binary")), 1, state["digits"]).alias("part")
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in _SCHEMA.fields])
        batch = stored(rows.select("*", part), "batch")
        touched = sorted(r["part"] for r in batch.select("part").distinct().collect())  # at most 16^digits names
        if not touched:
            return []
        version = state["version"] + 1
        old = self._rows({p: state["parts"][p] for p in touched if p in state["parts"]})
        age = [F.col("created_at"), F.col("response")]
        both = old.select(*STORED, F.lit(0).alias("_new")).unionByName(batch.select(*STORED, F.lit(1).alias("_new")))
        merged = last_by(both, ["cache_key"], age) if newest else first_by(both, ["cache_key"], [F.col("_new"), *age])
        # parts are split and joined to files of good size at run time; a folder of this version can only be of a failed batch
        out = merged.select(*STORED, part).hint("rebalance", "part")
        out.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/data/v={version}")
        self._write_state({"version": version, "digits": state["digits"], "parts": state["parts"] | dict.fromkeys(touched, version)})
        return touched

    def vacuum(self) -> int:
        """Removes folders and versions that the newest version does not need; gives how many parts went."""
        from pyarrow import fs

        state, names = self._state(), self._versions()
        store, root = _store(f"{self.path}/data")
        gone = 0
        for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            version = int(f.base_name.removeprefix("v=")) if f.base_name.startswith("v=") else None
            if version is None:
                continue
            parts = [p for p in store.get_file_info(fs.FileSelector(f.path)) if p.base_name.startswith("part=")]
            lost = [p for p in parts if state["parts"].get(p.base_name.removeprefix("part=")) != version]
            for p in lost:
                store.delete_dir(p.path)
            gone += len(lost)
            if len(lost) == len(parts):
                store.delete_dir(f.path)
        for name in names[:-1]:
            store.delete_file(name)
        return gone

