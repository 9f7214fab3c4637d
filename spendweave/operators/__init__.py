"""DataFrame in, DataFrame out: every analytic step of the engine."""
