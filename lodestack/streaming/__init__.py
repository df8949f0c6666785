"""Time- and state-dependent behaviour: batch forms and Structured Streaming."""
