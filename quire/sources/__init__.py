"""Reading and writing libraries, notes and results."""
