"""Column functions for time series and closed-form distribution functions."""
