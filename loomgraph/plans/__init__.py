"""Query modes, the engine facade, and the registered queries with their SQL."""
