"""Plan helpers shared by the operators: durable cuts of lineage, frontier loops, ranked picks."""
