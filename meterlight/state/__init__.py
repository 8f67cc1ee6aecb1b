"""What is kept between runs."""
