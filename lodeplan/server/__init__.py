"""Front doors: tools for agents, JSON-RPC over stdio and HTTP, REST, and a command line.  All share one engine."""
