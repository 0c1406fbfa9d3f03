from .tables import TABLES, load, load_all, read_code_jsonl, read_code_tree, read_code_lines, read_features, read_datasets
from .sinks import bucketed_documents, prepared, write_dataset, write_features, write_results

__all__ = ["TABLES", "load", "load_all", "read_code_jsonl", "read_code_tree", "read_code_lines",
           "read_features", "read_datasets", "write_dataset", "write_features", "write_results", "prepared",
           "bucketed_documents"]
