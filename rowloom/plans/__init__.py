"""Plan shapes shared by the operators: block-wise ranks, similarity joins, one-to-one matching."""
