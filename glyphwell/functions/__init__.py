"""Column functions and the Python kernels behind the few that need one."""
