"""Private record linkage: encode, block, weigh and prune pairs, match, cluster, evaluate."""
