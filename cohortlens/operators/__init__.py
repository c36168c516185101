from .clean import drop_all_null_columns, fill_missing, non_null_counts, union_by_name
from .encode import one_hot, top_values
from .grouping import (conditional_long, distinct_values, entropy, long_to_map, long_to_wide,
                       n_most_common)
from .joins import (assemble, attach_label, attach_status, checked_broadcast, fits_broadcast,
                    lookup_join)
from .keys import bucket_of, duplicate_keys, generate_key, orphan_links, with_bucket
from .visibility import attach_cutoff, visible_rows

__all__ = [n for n in dir() if not n.startswith("_")]
