"""Column functions of the engine: text, ids, parsing, tokens."""
