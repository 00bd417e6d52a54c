"""Planning: run tables, configuration, and the processing chain."""
