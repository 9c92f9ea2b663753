"""The registry facade, versioned state, and the registered queries with their SQL."""
