"""How plans are cut and iterated: shared-folder checkpoints and distributed row numbers."""
