"""Array kernels for one image or one ring: what is order-dependent or iterative. None needs Spark."""
