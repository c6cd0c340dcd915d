"""What a miss costs, by class."""

# The weight of each class in training.
COST = {"baixo": 1.0, "medio": 3.0, "alto": 6.0}
