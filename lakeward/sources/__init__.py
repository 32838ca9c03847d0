from lakeward.sources.files import (  # noqa: F401
    append_results,
    read_results,
    reset_all,
    reset_results,
    scan_catalog,
    scan_tasks,
    write_edges_catalog,
    write_model_export,
    write_model_rows,
)
