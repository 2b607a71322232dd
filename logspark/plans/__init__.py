"""Table-maintenance jobs: compaction and retention."""
