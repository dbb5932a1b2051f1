"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canlake.sources.shared import shared_folder


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo `mod`; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)


def row_key(doc_id: Column, text: Column) -> Column:
    """A 64-bit key of a row that also tells rows with NULL or repeated ids apart by their text."""
    return F.xxhash64(doc_id.cast("string"), text)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tokenizer_path(name: str) -> str:
    """A vocabulary file of a public tokenizer; the folder is CANLAKE_TOKENIZERS or /opt/tokenizers."""
    return os.path.join(os.environ.get("CANLAKE_TOKENIZERS", "/opt/tokenizers"), name)


def worker_store(owner: str) -> dict:
    """A dict that lives as long as the Python process, so that a reused worker builds costly objects once.

    One operator owns it: what another one kept goes first, and the memory of both goes back to the system, since workers
    outlive the stages that filled them and share their executor's memory.
    """
    module = sys.modules.setdefault("canlake_worker_store", types.ModuleType("canlake_worker_store"))
    kept = module.__dict__.setdefault("kept", {})
    if kept.get("owner") != owner:
        kept.clear()
        kept["owner"] = owner
        release()
    return kept


def release() -> None:
    """Hands freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
