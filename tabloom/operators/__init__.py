"""DataFrame in, DataFrame out: the steps of a modelling workflow."""
