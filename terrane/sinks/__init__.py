"""Writers: raw payloads, datasets and versioned tables, all append-only."""
