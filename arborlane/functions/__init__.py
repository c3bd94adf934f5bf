"""Column functions and building blocks that the operators share."""
