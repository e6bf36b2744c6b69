"""Multi-operator plans: factor block, screening, training."""
