"""Plans composed from the operators: calculators, categories, reports, registered queries."""
