"""Sources and sinks: CSV with inferred types, file positions, JSON export."""
