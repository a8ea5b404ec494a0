"""Query plans over the driver tables: fixtures, registered queries, oracle SQL."""
