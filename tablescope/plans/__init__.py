"""Physical building blocks shared by operators: exact order statistics,
value frequencies, ordered windows that survive hot groups, and lineage cuts."""
