"""Query arguments as DataFrame and Column expressions."""
