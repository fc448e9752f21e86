"""DataFrame-in, DataFrame-out statistics over whole columns."""
