"""SQL, dataflow graphs, the engine that binds them, and reference tables."""
