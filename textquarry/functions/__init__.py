"""Column functions and the Arrow kernels behind them."""
