"""Sends the package to the executors of a session that cannot import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession

_sent: WeakKeyDictionary = WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Once for each context: a zip of the package goes along with its tasks."""
    sc = spark.sparkContext
    if sc in _sent:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quillstone-"), "quillstone.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    _sent[sc] = path
