"""Stage wiring: which operator feeds which, and what is kept between them."""
