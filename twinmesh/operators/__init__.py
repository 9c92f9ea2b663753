"""Set operators: joins, components, ranking, statistics, mutations, skew handling."""
