"""Column functions shared by the operators: money, text and time."""
