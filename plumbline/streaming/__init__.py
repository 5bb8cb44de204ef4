"""Message streams: compaction, collection, change detection, transfers and playback, on Structured Streaming and in batch."""
