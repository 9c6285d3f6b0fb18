"""Signal kernels in numpy, and the Arrow functions that run them a row at a time."""
