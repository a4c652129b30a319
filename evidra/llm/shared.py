"""Small helpers of the operators in this subpackage; folders and tables are those of ``evidra.sources.shared``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.sources.shared import checkpoint_root, forget, new_folder, stored, table

__all__ = ["checkpoint_root", "crc_mod", "forget", "new_folder", "stored", "table"]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(n), F.lit(0))
