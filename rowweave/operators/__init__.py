"""The codec: Arrow batches to rows of bytes and back, and a slow row-by-row form of it."""
