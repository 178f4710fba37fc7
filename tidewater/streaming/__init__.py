"""The batch operators on streams: same functions, same log."""
