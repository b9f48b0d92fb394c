from .readers import check_unique, clean_headers, nan_to_null, read_ads, read_behaviors, read_exposures, read_profiles, read_table
from .shared import own_folder, written
from .writers import materialize_behaviors, write_sample

__all__ = ["check_unique", "clean_headers", "materialize_behaviors", "nan_to_null", "own_folder", "read_ads", "read_behaviors", "read_exposures", "read_profiles", "read_table", "write_sample", "written"]
