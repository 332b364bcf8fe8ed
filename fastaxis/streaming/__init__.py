"""Structured Streaming: the keyed debounce and its batch form."""
