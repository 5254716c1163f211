"""Model fits, run matrices and effect reports composed from the operators."""
