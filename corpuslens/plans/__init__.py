"""Plan helpers: written intermediate tables and gapless distributed numbering."""
