"""Plan-level helpers: checkpointing and fixpoint loops."""
