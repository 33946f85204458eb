"""Column functions: arithmetic on cells, scores, geodesy. All are expressions that Catalyst compiles; a NULL input cell gives NULL."""
