from propkit.sources.readers import preview, read_smi, read_table, table_summary
from propkit.sources.sinks import (load_pipeline, read_sidecar, read_vectors, save_model, write_results,
                                   write_sidecar, write_table, write_vectors)

__all__ = ["read_table", "read_smi", "preview", "table_summary", "write_table", "write_vectors",
           "read_vectors", "write_sidecar", "read_sidecar", "save_model", "load_pipeline", "write_results"]
