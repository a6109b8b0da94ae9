"""Where rows come from: driver tables, generators, CSV files."""
