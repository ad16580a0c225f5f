"""The row-wise operators on an append-only file stream."""
