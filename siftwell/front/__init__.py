"""What stands before the engine: roots, access, tools, text answers, requests."""
