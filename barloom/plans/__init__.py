"""How ordered work is laid out over the cluster: positions, row blocks, scans, exact quantiles."""
