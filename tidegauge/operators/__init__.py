"""DataFrame -> DataFrame transforms over samples, counters and snapshots."""
