from tillroll.streaming.kpis import event_stream, read_latest, run_to_table, weekly_kpis  # noqa: F401
