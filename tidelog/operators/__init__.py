"""DataFrame operators over command logs, placements and replication tables."""
