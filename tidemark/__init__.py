"""tidemark of the engine."""
