from loomwright.sources.readers import (  # noqa: F401
    align_external, parse_frames, read_csv, read_dimension, read_frame_files, read_label_matrix, table,
)
from loomwright.sources.sinks import (  # noqa: F401
    merge_partitions, upsert_results, write_json_report, write_ordered_csv, write_predictions,
)
