"""Structured Streaming: the confirm-twice state machine and the seen set."""
