"""Tables, file sources and sinks."""
