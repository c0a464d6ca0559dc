"""Change-data tables on Spark: current state, history and snapshots from I/U/D feeds."""
