"""DataFrame to DataFrame operators: lazy, and without collecting rows."""
