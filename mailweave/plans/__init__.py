"""Ready-made queries over the shared test tables, by area; ``registry`` gathers them."""
