"""Sources: evaluation and ground-truth JSON, images, recognition engines, settings."""
