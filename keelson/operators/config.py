"""Engine settings and the sizes that follow from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of a small store. A page has block_size bytes whatever is set; there is no cache of block_cache_size of our own, pages that are read again are for Spark to persist."""

    memtable_size: int = 2 << 20
    l0_compaction_trigger: int = 3
    level_multiplier: int = 10
    target_file_size: int = 4 << 20
    block_size: int = 4096
    block_cache_size: int = 4 << 20
    bloom_bits_per_key: int = 10
    max_levels: int = 5

    def max_level_size(self, level: int) -> int:
        """Bytes that a level may hold: the first by its number of files, the others by powers of the multiplier."""
        files = self.l0_compaction_trigger if level == 0 else self.level_multiplier**level
        return self.target_file_size * files

    def level_capacity(self, level: Column) -> Column:
        """max_level_size of a column of levels."""
        by_power = F.pow(F.lit(self.level_multiplier), level).cast("bigint")
        return F.lit(self.target_file_size) * F.when(level == 0, F.lit(self.l0_compaction_trigger)).otherwise(by_power)
