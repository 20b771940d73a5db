"""Streaming: the engine answers batch questions only; event tables are read as ordinary facts with hour, day and week grains."""
