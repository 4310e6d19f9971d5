from waymark.plans.commands import main

main()
