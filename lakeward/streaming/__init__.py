from lakeward.streaming.upsert import current_results, init_results, stream_upsert  # noqa: F401
