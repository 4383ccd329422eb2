"""Expression building blocks shared by the operators."""
